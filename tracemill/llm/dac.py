"""Token-ID output in directly addressable codes.

An id is split from its low end into chunks of ``WIDTHS`` bits. Level 0 holds the first chunk of every id, level k the
next chunk of those ids that need it. A continuation bitmap per level (none on the last) says which ids go on, and a
rank directory (ones before every 512th bit) finds an id's place on the next level, so any id or run of ids is read by
address, without decoding what stands before it.

A file is a Parquet table; a row is a segment: whole documents, closed at ``SEGMENT`` ids. Segments of all parts in
order (part, segment) hold the documents by ascending id. Documents sort by id (null last), then by text hash; a null
text is empty. Every document ends with ``END_ID``."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm import common
from tracemill.session import work_folder

WIDTHS = (10, 3, 19)      # bits of a chunk by level; the sum bounds an id
SEGMENT = 1_000_000       # ids after which a segment is closed
EVERY = 512               # bits between two entries of a rank directory
RUN = 1 << 22             # bytes of text whose words a task looks up at a time
END_ID = 2
FILE = "part int, segment int, doc_ids array<bigint>, lengths array<bigint>, n_ids long, chunks array<binary>, goes_on array<binary>, ranks array<binary>"
ROW = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()),
                 *[(c, pa.list_(pa.binary())) for c in ("chunks", "goes_on", "ranks")]])


def _parts(width: int) -> list[tuple[int, int, int]]:
    """Eight values fill ``width`` bytes: (value, byte, shift) of every overlap; the byte has the value's bits shifted right by
    shift (left, if negative)."""
    return [(i, j, (i + 1) * width - 8 * (j + 1)) for j in range(width) for i in range(8 * j // width, min(8, -(-8 * (j + 1) // width)))]


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after the other, highest first."""
    n, groups = len(values), -(-len(values) // 8)
    wide = np.zeros(groups * 8, np.uint32)
    wide[:n] = values
    v = np.ascontiguousarray(wide.reshape(-1, 8).T)
    out = np.zeros((width, groups), np.uint8)
    for i, j, shift in _parts(width):
        out[j] |= (v[i] >> np.uint32(shift) if shift >= 0 else v[i] << np.uint32(-shift)).astype(np.uint8)
    return out.T.tobytes()[:(n * width + 7) // 8]


def unpack_bits(data: bytes, width: int, begin: int, end: int) -> np.ndarray:
    """Values ``begin`` to ``end`` of a packed array; touches only their bytes."""
    first, groups = begin // 8, -(-end // 8) - begin // 8
    raw = np.zeros(groups * width, np.uint8)
    some = np.frombuffer(data, np.uint8, count=(end * width + 7) // 8 - first * width, offset=first * width)
    raw[:len(some)] = some
    b = np.ascontiguousarray(raw.reshape(-1, width).T).astype(np.uint32)
    out = np.zeros((8, groups), np.uint32)
    for i, j, shift in _parts(width):
        out[i] |= b[j] << np.uint32(shift) if shift >= 0 else b[j] >> np.uint32(-shift)
    out &= np.uint32((1 << width) - 1)
    return out.T.reshape(-1)[begin - 8 * first:end - 8 * first]


def encode(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """The levels' chunks, continuation bitmaps and rank directories."""
    chunks, goes_on, ranks = [], [], []
    rest = ids.astype(np.uint32)
    if len(rest) and int(rest.max()) >> sum(widths):
        raise ValueError("an id is wider than all levels")
    for k, width in enumerate(widths):
        chunks.append(pack_bits(rest & np.uint32((1 << width) - 1), width) if len(rest) else b"")
        if k + 1 == len(widths):
            break
        more = (rest >> np.uint32(width)) > 0
        goes_on.append(np.packbits(more).tobytes())
        ones = np.concatenate((np.zeros(1, np.int64), np.cumsum(more)))
        ranks.append(ones[0:len(more) + 1:EVERY].astype("<u4").tobytes())
        rest = rest[more] >> np.uint32(width)
    return chunks, goes_on, ranks


def rank(goes_on: bytes, ranks: bytes, at: int) -> int:
    """Ones before bit ``at``: a directory entry and at most EVERY bits."""
    block = at // EVERY
    base = int(np.frombuffer(ranks, "<u4", count=1, offset=4 * block)[0])
    first = block * EVERY
    if at == first:
        return base
    raw = np.unpackbits(np.frombuffer(goes_on, np.uint8, count=(at + 7) // 8 - first // 8, offset=first // 8))
    return base + int(raw[:at - first].sum())


def access(chunks: list[bytes], goes_on: list[bytes], ranks: list[bytes], begin: int, end: int, widths: tuple[int, ...] = WIDTHS) -> np.ndarray:
    """Ids ``begin`` to ``end`` of a segment."""
    if end <= begin:
        return np.zeros(0, np.uint32)
    out = unpack_bits(chunks[0], widths[0], begin, end)
    at, shift = np.arange(end - begin), 0
    for k in range(len(widths) - 1):
        bits = np.unpackbits(np.frombuffer(goes_on[k], np.uint8, count=(end + 7) // 8 - begin // 8, offset=begin // 8))
        more = bits[begin % 8:begin % 8 + end - begin] == 1
        n = int(more.sum())
        if not n:
            break
        begin = rank(goes_on[k], ranks[k], begin)
        end, at, shift = begin + n, at[more], shift + widths[k]
        out[at] |= unpack_bits(chunks[k + 1], widths[k + 1], begin, end) << np.uint32(shift)
    return out


# Words of these letters alone pass the tokenizer's normaliser and splitter as one piece, in lower case; they go straight to
# its model. Others take the whole way.
PLAIN = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00DE\u00DF-\u00F6\u00F8-\u00FF]+")
TAIL = b".,!?;:%&$*#"     # signs that the tokenizer cuts off a letter before them


def ends_in_letter(core: str) -> bool:
    """Also after normalising: some letters end in a mark then, which the tokenizer joins with the signs behind it."""
    return core[-1].isalpha() and (core[-1].isascii() or unicodedata.normalize("NFC", core).lower()[-1].isalpha())


def _bytes(values: pa.Array) -> list[bytes]:
    return values.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


class Tokens:
    """Ids of texts by way of their distinct words. The tokenizer never joins across white space, so a word's ids do not depend on
    its neighbours; and it cuts signs off the letter before them, so a word and its last signs are looked up apart."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {i: signs.pre_tokenize_str(chr(i))[0][0] for i in [*range(97, 123), *range(0xDF, 0x100)]}
        self.cache = common.WordCache(self._encode, 500_000)

    def _encode(self, words: list[bytes]) -> list[bytes]:
        ids, tokenize = [], self.model.tokenize
        for w in words:
            if w.isalpha():                                       # ASCII letters stand for themselves
                ids.append([x.id for x in tokenize(w.lower().decode())])
                continue
            text = w.decode("utf-8", "surrogatepass")
            if PLAIN.fullmatch(text):
                ids.append([x.id for x in tokenize(text.lower().translate(self.spelled))])
            else:
                ids.append(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return common.packed(ids, "<u4")

    def _cut(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Each word without and with only its last signs, where the tokenizer cuts there; else whole and empty. ASCII is in lower
        case, but for words that may hold a special token."""
        cores = pc.ascii_rtrim(words, TAIL.decode())
        size = pc.binary_length(cores)
        letter, other = pc.match_substring_regex(cores, "[A-Za-z]$").to_numpy(False), pc.match_substring_regex(cores, "[^\x00-\x7F]$").to_numpy(False)
        special = pc.match_substring(words, "<").to_numpy(False)
        cut = (size.to_numpy() < pc.binary_length(words).to_numpy()) & ~special & (letter | other)
        doubt = np.flatnonzero(cut & other)
        cut[doubt] = [ends_in_letter(w) for w in cores.take(pa.array(doubt)).to_pylist()]
        ends = pa.array([w[n:] for w, n in zip(_bytes(words.filter(pa.array(cut))), size.to_numpy()[cut].tolist(), strict=True)], pa.binary())
        tails = pc.replace_with_mask(pa.array([b""] * len(words), pa.binary()), pa.array(cut), ends)
        cores = pc.if_else(pa.array(cut), cores, words)
        return pc.if_else(pc.and_(pc.string_is_ascii(cores), pa.array(~special)), pc.ascii_lower(cores), cores).cast(pa.binary()), tails

    def ids(self, text: str | None) -> bytes:
        return self.many(pa.array([text], pa.string()))[0].tobytes()

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids begin (one more than texts). A distinct word is
        cut and looked up once, whatever its number."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()
        core, tail = (c.dictionary_encode() for c in self._cut(words.dictionary))
        of_core, of_tail = (self.cache.take(_bytes(c.dictionary)) for c in (core, tail))
        found = [of_core[c] + of_tail[t] for c, t in zip(core.indices.to_numpy().tolist(), tail.indices.to_numpy().tolist(), strict=True)]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, first, at = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size, words.indices.to_numpy()
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(size[at])))
        ids = flat[np.arange(ends[-1]) + np.repeat(first[at] - ends[:-1], size[at])]
        return ids, ends[split.offsets.to_numpy()]


_loaded: dict[str, Tokens] = {}


def tokens_for(path: str) -> Tokens:
    """One tokenizer and cache for each Python worker."""
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (doc, text) in runs of about ``RUN`` bytes of text, from many short batches or a part of one: memory follows the
    longest text, not the batch."""
    held, size = [], 0
    for batch in batches:
        begin = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().tolist()):
            size += n
            if size >= RUN:
                yield pa.concat_batches([*held, batch.slice(begin, i + 1 - begin)])
                begin, held, size = i + 1, [], 0
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield pa.concat_batches(held)


def _write(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, segment = tokens_for(path), TaskContext.get().partitionId(), 0
        doc_ids, lengths, held, n = [], [], [], 0

        def close():
            ids = np.concatenate(held)
            chunks, goes_on, ranks = encode(ids)
            return pa.RecordBatch.from_pylist([{"part": part, "segment": segment, "doc_ids": doc_ids, "lengths": lengths, "n_ids": len(ids),
                                                "chunks": chunks, "goes_on": goes_on, "ranks": ranks}], ROW)
        for rows in _runs(batches):
            ids, begin = tokens.many(rows.column(1))
            ids = np.insert(ids, begin[1:], end_id)               # behind each document, so each begins one further than the last
            begin = (begin + np.arange(len(begin))).tolist()
            for i, doc in enumerate(rows.column(0).to_numpy().tolist()):
                doc_ids.append(doc)
                lengths.append(begin[i + 1] - begin[i])
                held.append(ids[begin[i]:begin[i + 1]])
                n += lengths[-1]
                if n >= SEGMENT:
                    yield close()
                    segment, doc_ids, lengths, held, n = segment + 1, [], [], [], 0
        if held:
            yield close()
    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode whole texts and write the token file. Ranges of ids go to tasks, so each task writes its part in order."""
    keyed = common.rows_keyed(docs)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(n, "doc", "tid").sortWithinPartitions("doc", "tid").select("doc", "text")
    dealt.mapInArrow(_write(tokenizer, end_id), FILE).write.parquet(folder)


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for r in pdf.to_dict("records"):
            ids = access(list(r["chunks"]), list(r["goes_on"]), list(r["ranks"]), 0, int(r["n_ids"])).astype("<u4")
            ends = np.cumsum(np.asarray(r["lengths"], np.int64))
            begins = ends - np.asarray(r["lengths"], np.int64)
            raw = memoryview(ids.tobytes())
            doc = pd.Series(np.asarray(r["doc_ids"], np.int64)).astype("Int64")
            yield pd.DataFrame({"part": r["part"], "segment": r["segment"], "doc_id": doc.mask(doc == 2 ** 63 - 1), "inside": begins, "n_tokens": ends - begins,
                                "ids_crc32": [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begins, ends, strict=True)]})


def places(segments: DataFrame) -> DataFrame:
    """(part, segment, before): the ids of all segments before this one. Sums of parts are carried on into the parts, so no
    task sees more than the segments of one part, or one row for each part."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("carried"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = segments.select("part", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside"))
    return sums.join(carried, "part").select("part", "segment", (F.col("inside") + F.col("carried")).alias("before"))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in a token file. Only document rows meet the places of their
    segments; the codes themselves are not shuffled."""
    segments = spark.read.schema(FILE).parquet(folder)
    rows = segments.mapInPandas(_read, "part int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(places(segments.select("part", "segment", "n_ids")), ["part", "segment"]).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    folder = work_folder(docs.sparkSession, "tokens")
    write_tokens(docs, folder, tokenizer, end_id)
    return read_tokens(docs.sparkSession, folder)
