"""Substring dedup: words covered by a window of words that also starts earlier are removed.

1. Every partition sketches its windows (count-min: the slots hit, in ``ROWS`` hash rows). Slot lists are merged by
   block into counters that saturate at two; a counter never undercounts, so a repeated window always shows two.
2. The bits "counted twice or more" (``2^log2_slots`` per row at most: a fixed bound) go to all tasks. A second pass
   keeps only windows whose counters all show two and groups them exactly by a 128-bit hash. Inside a run of windows
   one task keeps only the first start of each hash, the rest are known repeats; so a hash sends at most one row per
   run to its group, whatever the number of copies.
3. Starts of repeated windows return to their documents in bundles, and the words they cover go.

Null ids sort last; rows that share an id are told apart by the whole 64-bit hash of their text, rows equal in both are one document (each row
is returned). Null and empty texts have no words and hash the empty string."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import common

ROWS = 3
BLOCK_BITS = 20           # slots of one merge block: 2^20
RUN = 2_000_000           # windows a task handles at a time
LAST_ID = 2 ** 63 - 1
RECORD = np.dtype([("doc", "<i8"), ("tid", "<i8"), ("start", "<i4")])
PACK, UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def sketch_bits(text_bytes: int, most: int = 28) -> int:
    """log2 of the slots of a row: about twelve slots a window where the bound allows; six bytes are taken for a word."""
    return min(most, max(BLOCK_BITS, math.ceil(math.log2(max(1, text_bytes) * 2))))


def _hashed(frames: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(h1, h2, doc, pos, tid) of all windows, chunk by chunk."""
    for pdf, docs in common.chunks(frames):
        h, begin = common.hash_docs(docs)
        counts = np.diff(begin)
        if len(h) < size:
            continue
        starts = np.arange(len(h) - size + 1)
        own = np.repeat(np.arange(len(docs)), counts)[:len(starts)]
        inside = starts + size <= begin[own + 1]
        own, starts = own[inside], starts[inside]
        h1 = common.windows(h, size)[inside]
        h2 = common.windows(common.mix(h ^ np.uint64(0xA5A5F00DC0FFEE11)), size)[inside]
        yield h1, h2, pdf["doc"].to_numpy(np.int64)[own], (starts - begin[own]).astype(np.int32), pdf["tid"].to_numpy(np.int64)[own]


def _slots(h1: np.ndarray, h2: np.ndarray, bits: int) -> list[np.ndarray]:
    """A slot in each hash row; the rows' hashes are two independent ones and their mixture."""
    return [(h >> np.uint64(64 - bits)).astype(np.int64) for h in (h1, h2, common.mix(h1 + (h2 << np.uint64(1))))]


def pack_gaps(values: np.ndarray) -> bytes:
    """Sorted numbers as gaps of one byte; 255 carries on into the next byte."""
    gaps = np.diff(values, prepend=0)
    long = gaps // 255
    out = np.full(int(long.sum()) + len(gaps), 255, np.uint8)
    out[np.cumsum(long + 1) - 1] = gaps % 255
    return out.tobytes()


def unpack_gaps(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return np.cumsum(raw, dtype=np.int64)[raw != 255]


def _sketch(size: int, bits: int):
    def run(frames):
        held: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        n = 0

        def flush():
            out = []
            for row in range(ROWS):
                if held[row]:
                    slots = np.sort(np.concatenate(held[row]))
                    block = slots >> BLOCK_BITS
                    edge = np.flatnonzero(np.diff(block, prepend=-1))
                    for a, b in zip(edge, [*edge[1:], len(slots)], strict=True):
                        out.append(((row << 32) | int(block[a]), pack_gaps(slots[a:b] - (block[a] << BLOCK_BITS))))
                held[row] = []
            return pd.DataFrame(out, columns=["block", "slots"])
        for h1, h2, *_ in _hashed(frames, size):
            for row, s in enumerate(_slots(h1, h2, bits)):
                held[row].append(s)
            n += len(h1)
            if n >= 4 * RUN:
                yield flush()
                n = 0
        yield flush()
    return run


def _merge(frames):
    """Blocks arrive in order: one block of counters in memory at a time."""
    now, seen = None, None
    for pdf in frames:
        out = []
        for block, slots in zip(pdf["block"], pdf["slots"], strict=True):
            if block != now:
                if now is not None:
                    out.append((now, np.packbits(seen >= 2).tobytes()))
                now, seen = block, np.zeros(1 << BLOCK_BITS, np.uint8)
            at, n = np.unique(unpack_gaps(slots), return_counts=True)
            seen[at] = np.minimum(2, seen[at] + np.minimum(n, 2).astype(np.uint8))
        if out:
            yield pd.DataFrame(out, columns=["block", "bits"])
    if now is not None:
        yield pd.DataFrame([(now, np.packbits(seen >= 2).tobytes())], columns=["block", "bits"])


def repeated_bits(keyed: DataFrame, size: int, bits: int) -> np.ndarray:
    """The merged sketch: for each row the slots that were hit twice or more, eight to a byte. ROWS * 2^bits bits."""
    parts = keyed.select("text", "doc", "tid").mapInPandas(_sketch(size, bits), "block long, slots binary")
    merged = parts.repartition(F.col("block")).sortWithinPartitions("block").mapInPandas(_merge, "block long, bits binary")
    table = np.zeros((ROWS, 1 << (bits - 3)), np.uint8)
    step = 1 << (BLOCK_BITS - 3)
    for r in merged.toLocalIterator():
        row, block = r["block"] >> 32, r["block"] & 0xFFFFFFFF
        table[row, block * step:(block + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return table


def _first_of_each(k1, k2, doc, at, tid):
    """The order of the rows by key and start, and which of them begin a key. A start that stands twice (rows equal in id
    and text) counts once."""
    order = np.lexsort((tid, at, doc, k2, k1))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for column in (k1, k2, doc, at, tid):
        held = column[order]
        new[1:] |= held[1:] != held[:-1]
    order = order[new]
    a, b = k1[order], k2[order]
    first = np.ones(len(order), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, first


def _estimated(size: int, bits: int, table, n_bundles: int):
    def run(frames):
        held, n, bitmaps = [], 0, table.value

        def flush():
            if not held:
                return
            k1, k2, doc, at, tid = (np.concatenate(x) for x in zip(*held, strict=True))
            order, first = _first_of_each(k1, k2, doc, at, tid)
            again = order[~first]                                                           # repeats of an earlier start in this run
            for name, blob in bundles(doc[again], at[again], tid[again], n_bundles):
                yield pd.DataFrame({"k1": name, "k2": 0, "doc": 0, "at": np.int32(0), "tid": 0, "blob": [blob]})
            order = order[first]                                                            # one row for each hash
            for i in range(0, len(order), 200_000):
                j = order[i:i + 200_000]
                yield pd.DataFrame({"k1": k1[j].view(np.int64), "k2": k2[j].view(np.int64), "doc": doc[j], "at": at[j], "tid": tid[j], "blob": None})
        for h1, h2, doc, at, tid in _hashed(frames, size):
            hit = np.ones(len(h1), bool)
            for row, s in enumerate(_slots(h1, h2, bits)):
                hit &= (bitmaps[row][s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1
            if hit.any():
                held.append((h1[hit], h2[hit], doc[hit], at[hit], tid[hit]))
                n += int(hit.sum())
            if n >= RUN:
                yield from flush()
                held, n = [], 0
        yield from flush()
    return run


def bundles(doc: np.ndarray, at: np.ndarray, tid: np.ndarray, n_bundles: int) -> list[tuple[int, bytes]]:
    """Starts packed by a hash of their document (id and text: rows without ids spread like others): (bundle,
    little-endian (doc, tid, start) records)."""
    if not len(doc):
        return []
    name = (common.mix(doc.view(np.uint64) ^ tid.view(np.uint64)) % np.uint64(n_bundles)).astype(np.int64)
    order = np.lexsort((at, tid, doc, name))
    rows = np.empty(len(doc), RECORD)
    rows["doc"], rows["tid"], rows["start"], name = doc[order], tid[order], at[order], name[order]
    edge = np.flatnonzero(np.diff(name, prepend=-1))
    return [(int(name[a]), PACK.compress(rows[a:b].tobytes())) for a, b in zip(edge, [*edge[1:], len(name)], strict=True)]


def _later(n_bundles: int):
    """From rows in key order: starts that are not the first of their hash, bundled; bundles that are there already pass."""
    def run(frames):
        last, held, n = (None,) * 5, [], 0

        def flush():
            return pd.DataFrame(bundles(*(np.concatenate(x) for x in zip(*held, strict=True)), n_bundles), columns=["bundle", "blob"])
        for pdf in frames:
            done = pdf["blob"].notna().to_numpy()
            if done.any():
                yield pd.DataFrame({"bundle": pdf["k1"][done], "blob": pdf["blob"][done]})
                pdf = pdf[~done]
            k1, k2 = pdf["k1"].to_numpy(np.int64), pdf["k2"].to_numpy(np.int64)
            if not len(k1):
                continue
            same = np.zeros(len(k1), bool)
            same[1:] = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
            same[0] = last[:2] == (k1[0], k2[0])
            doc, at, tid = pdf["doc"].to_numpy(np.int64), pdf["at"].to_numpy(np.int32), pdf["tid"].to_numpy(np.int64)
            twin = np.zeros(len(k1), bool)                 # the same start once more
            twin[1:] = (doc[1:] == doc[:-1]) & (at[1:] == at[:-1]) & (tid[1:] == tid[:-1])
            twin[0] = last[2:] == (doc[0], at[0], tid[0])
            last = (k1[-1], k2[-1], doc[-1], at[-1], tid[-1])
            same &= ~twin
            if same.any():
                held.append((doc[same], at[same], tid[same]))
                n += int(same.sum())
            if n >= RUN:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()
    return run


def _gathered(frames):
    """Bundles arrive in order; one is unpacked at a time into a row for each of its documents."""
    now, held = None, []

    def flush():
        rows = np.sort(np.concatenate(held))
        edge = np.flatnonzero(np.concatenate(([True], (rows["doc"][1:] != rows["doc"][:-1]) | (rows["tid"][1:] != rows["tid"][:-1]))))
        starts = rows["start"].astype("<i4")
        return pd.DataFrame([(int(rows["doc"][a]), int(rows["tid"][a]), starts[a:b].tobytes()) for a, b in zip(edge, [*edge[1:], len(rows)], strict=True)],
                            columns=["doc", "tid", "starts"])
    for pdf in frames:
        for bundle, blob in zip(pdf["bundle"], pdf["blob"], strict=True):
            if bundle != now and held:
                yield flush()
                held = []
            now = bundle
            held.append(np.frombuffer(UNPACK.decompress(blob), RECORD))
    if held:
        yield flush()


def repeated_starts(docs: DataFrame, size: int = 20, most_bits: int = 28) -> DataFrame:
    """(doc, tid, starts): little-endian 32-bit starts of a document's windows that also start earlier."""
    spark = docs.sparkSession
    keyed = common.rows_keyed(docs, tid_bits=64)
    text_bytes = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = sketch_bits(text_bytes, most_bits)
    table = spark.sparkContext.broadcast(repeated_bits(keyed, size, bits))
    n_bundles = min(1 << 16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = keyed.select("text", "doc", "tid").mapInPandas(_estimated(size, bits, table, n_bundles), "k1 long, k2 long, doc long, at int, tid long, blob binary")
    later = rows.repartition("k1").sortWithinPartitions("k1", "k2", "doc", "at", "tid").mapInPandas(_later(n_bundles), "bundle long, blob binary")
    return later.repartition("bundle").sortWithinPartitions("bundle").mapInPandas(_gathered, "doc long, tid long, starts binary")


def _cut(size: int):
    def run(frames):
        for pdf in frames:
            out = []
            for doc, text, starts in zip(pdf["doc"], pdf["text"], pdf["starts"], strict=True):
                words = common.words_of(text)
                kept = words
                if starts is not None and len(starts):
                    edge = np.zeros(len(words) + 1, np.int32)
                    at = np.unique(np.frombuffer(starts, "<i4")).astype(np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, np.minimum(at + size, len(words)), -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                joined = b" ".join(kept)
                out.append((None if doc == LAST_ID else doc, len(words), len(words) - len(kept), joined.decode("utf-8", "surrogatepass"),
                            hashlib.sha256(joined).hexdigest()))
            res = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])
            res["doc_id"] = res["doc_id"].astype("Int64")
            yield res
    return run


def dedup(docs: DataFrame, size: int = 20, most_bits: int = 28) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space), kept_sha256, for every row."""
    starts = common.saved(repeated_starts(docs, size, most_bits), "repeats")
    keyed = common.rows_keyed(docs, tid_bits=64)
    bits = 24
    table = common.bit_table(starts.select(F.xxhash64("doc", "tid").alias("key")), "key", bits)
    hit = common.has_bit(table, F.xxhash64("doc", "tid"), bits)
    schema = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    # only documents with repeats (and a few more: the bitmap may err that way) are shuffled to meet their starts
    whole = keyed.where(~hit).select("doc", "text", F.lit(None).cast("binary").alias("starts"))
    some = keyed.where(hit).join(starts, ["doc", "tid"], "left").select("doc", "text", "starts")
    return whole.mapInPandas(_cut(size), schema).unionByName(some.mapInPandas(_cut(size), schema))
