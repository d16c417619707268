"""Words, hashes, word caches and bounded filters shared by the operators of this subpackage.

Words are byte strings between ASCII white space (space and \\t to \\r), taken from the UTF-8 form, so other
Unicode spaces stay inside a word. A null text has no words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.session import materialise

CHUNK_BYTES = 1 << 19     # text hashed by one numpy call inside a task
BATCH_ROWS = 500          # rows of text in an Arrow batch
KEY_BITS = 16             # bits a key has in a bitmap that is not yet at its largest: at most one unknown key in 16 tests true
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, BASE, np.uint64))


_table = [_powers(256)]


def hash_joined(joined: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text that has one space between words."""
    buf = np.frombuffer(joined, np.uint8)
    if not len(buf):
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(buf == 32)
    starts = np.concatenate((np.zeros(1, np.int64), gaps + 1))
    lens = np.concatenate((gaps, np.array([len(buf)]))) - starts
    if lens.max() >= len(_table[0]):
        _table[0] = _powers(int(lens.max()) * 2)
    place = np.arange(len(buf)) - np.repeat(starts, lens + 1)[:len(buf)]
    terms = _table[0][place] * (buf.astype(np.uint64) + np.uint64(1))
    terms[gaps] = 0
    return mix(np.add.reduceat(terms, starts) + lens.astype(np.uint64))


def hash_stems(joined: bytes, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Like hash_joined for the first ``size`` bytes of every word, for each size; 0 means the whole word. Words no longer
    than the size have hash 0 there."""
    buf = np.frombuffer(joined, np.uint8)
    if not len(buf):
        return [np.zeros(0, np.uint64) for _ in sizes]
    gaps = np.flatnonzero(buf == 32)
    starts = np.concatenate((np.zeros(1, np.int64), gaps + 1))
    lens = np.concatenate((gaps, np.array([len(buf)]))) - starts
    if lens.max() >= len(_table[0]):
        _table[0] = _powers(int(lens.max()) * 2)
    place = np.arange(len(buf)) - np.repeat(starts, lens + 1)[:len(buf)]
    terms = _table[0][place] * (buf.astype(np.uint64) + np.uint64(1))
    terms[gaps] = 0
    whole = np.add.reduceat(terms, starts) if 0 in sizes else None
    out = []
    for size in sizes:
        if size == 0:
            out.append(mix(whole + lens.astype(np.uint64)))
        else:
            at = starts + size
            fits = lens > size
            h = np.zeros(len(starts), np.uint64)
            inside = np.minimum(at, len(buf) - 1)
            ends = np.cumsum(terms)
            h[fits] = mix((ends[inside] - terms[inside] - ends[starts] + terms[starts])[fits] + np.uint64(size << 32))
            out.append(h)
    return out


def hash_docs(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of several documents in one array, and where each document begins (one more than documents)."""
    counts = np.fromiter((len(d) for d in docs), np.int64, len(docs))
    return hash_joined(b" ".join([b" ".join(d) for d in docs if d])), np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:n].copy()
    for j in range(1, size):
        acc *= BASE
        acc += h[j:j + n]
    return mix(acc)


def digest128(data: bytes) -> tuple[int, int]:
    d = np.frombuffer(hashlib.blake2b(data, digest_size=16).digest(), np.int64)
    return int(d[0]), int(d[1])


def chunks(frames: Iterable[pd.DataFrame], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pd.DataFrame, list[list[bytes]]]]:
    """Runs of rows with about ``limit`` bytes of text, and their words: memory follows the longest text, not the batch."""
    for pdf in frames:
        begin, held, docs = 0, 0, []
        texts = pdf[text].tolist()
        for i, t in enumerate(texts):
            words = words_of(t)
            docs.append(words)
            held += sum(map(len, words)) + len(words)
            if held >= limit or i + 1 == len(texts):
                yield pdf.iloc[begin:i + 1], docs
                begin, held, docs = i + 1, 0, []


def text_runs(frames: Iterable[pd.DataFrame], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pd.DataFrame, list[str | None]]]:
    """Like ``chunks``, with the texts as they are."""
    for pdf in frames:
        begin, held, texts = 0, 0, pdf[text].tolist()
        for i, t in enumerate(texts):
            held += len(t or "")
            if held >= limit or i + 1 == len(texts):
                yield pdf.iloc[begin:i + 1], texts[begin:i + 1]
                begin, held = i + 1, 0


class WordCache:
    """Values of words that were seen before, in two generations of a bounded number of entries: a full young
    generation becomes the old one. ``make`` gets the list of missing words and returns their values."""

    def __init__(self, make: Callable[[list[bytes]], list], entries: int = 300_000):
        self.make, self.entries, self.young, self.old = make, entries, {}, {}

    def take(self, words: list[bytes]) -> list:
        young = self.young
        out = list(map(young.get, words))
        if None in out:
            new = []
            for w in {w for w, v in zip(words, out, strict=True) if v is None}:
                v = self.old.get(w)
                if v is None:
                    new.append(w)
                else:
                    young[w] = v
            if new:
                young.update(zip(new, self.make(new), strict=True))
            out = list(map(young.__getitem__, words))
        if len(young) > self.entries:
            self.old, self.young = young, {}
        return out


def packed(ids: list[list[int]], kind: str) -> list[bytes]:
    """Each list of numbers as bytes."""
    ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) * np.dtype(kind).itemsize
    flat = np.fromiter((x for i in ids for x in i), kind).tobytes()
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def short_batches(df: DataFrame) -> DataFrame:
    """Texts go to Python at most BATCH_ROWS rows at a time: buffers on both sides follow the batch, and rows are texts
    here. A session that asks for fewer keeps its number."""
    conf = df.sparkSession.conf
    rows = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def rows_keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tid_bits: int = 32) -> DataFrame:
    """(doc, tid, text): the id and a hash of the text (its low 32 bits or all 64), which tells apart rows that share an id. A
    null id sorts after all others."""
    return short_batches(docs).select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(2 ** 63 - 1)).alias("doc"),
                       F.col(text_col).cast("string").alias("text")).withColumn("tid", F.xxhash64("text").bitwiseAND(F.lit(-1 if tid_bits == 64 else 0xFFFFFFFF)))


def bits_for(n_keys: int, most: int) -> int:
    """The size for ``bit_table``, as a power of two: KEY_BITS a key up to 2^most. The table passes through the driver and with
    every stage that tests it, so few keys take a small one."""
    return min(most, max(10, (KEY_BITS * n_keys - 1).bit_length()))


def bit_table(keys: DataFrame, key: str, log2_bits: int) -> Column:
    """A bitmap of 2^log2_bits bits of the hashed keys as one scalar value (array of longs): its size does not depend on
    the number of keys. Test with ``has_bit``; unknown keys may test true, known keys always do."""
    spark = keys.sparkSession
    slot = F.shiftrightunsigned(F.col(key), 64 - log2_bits)
    words = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    full = spark.range(0, 1 << (log2_bits - 6), 1, 1).select(F.col("id").alias("at"), F.lit(0).cast("bigint").alias("bits"))
    one = words.unionByName(full).groupBy("at").agg(F.bit_or("bits").alias("bits")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "bits"))), lambda x: x["bits"]).alias("table"))
    return one.scalar()


def has_bit(table: Column, key: Column, log2_bits: int) -> Column:
    slot = F.shiftrightunsigned(key, 64 - log2_bits)
    return F.getbit(F.get(table, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1


def flagged(docs: DataFrame, keys: DataFrame, log2_bits: int = 24, tid_bits: int = 32) -> tuple[DataFrame, DataFrame]:
    """Split the rows of ``docs`` by a bitmap of (doc, tid) ``keys``, a written table, of at most 2^log2_bits bits: (surely not
    among them, maybe among them). The first
    is ``docs``, the second packs its columns into ``row`` beside doc and tid (the low 32 or all 64 bits of the text's hash), so
    that no name of the caller's meets these. Only the second side needs a shuffle to be told exactly."""
    log2_bits = bits_for(keys.count(), log2_bits)
    table = bit_table(keys.select(F.xxhash64("doc", "tid").alias("key")), "key", log2_bits)
    own = docs.select(F.struct(*docs.columns).alias("row"))
    own = own.select("row", F.coalesce(F.col("row.doc_id").cast("bigint"), F.lit(2 ** 63 - 1)).alias("doc"),
                     F.xxhash64(F.col("row.text").cast("string")).bitwiseAND(F.lit(-1 if tid_bits == 64 else 0xFFFFFFFF)).alias("tid"))
    hit = has_bit(table, F.xxhash64("doc", "tid"), log2_bits)
    return own.where(~hit).select("row.*"), own.where(hit)


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """Written to the shared folder and read back: the lineage ends there and survives lost executors."""
    return materialise(df, purpose)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
