"""Benchmark decontamination as a prefix-filtered set join; DataFrame functions only.

A window is ``size`` consecutive words of a benchmark item (the whole item if it has fewer). Its tokens are its shingles
of three words (of all its words if it has fewer). Ordered by rarity in the corpus, the rarest token is the necessary
prefix: a document holds the window only where it holds that token.

1. One pass over all documents finds where a window's token begins; a fixed-size bitmap keeps the other words out. The
   tokens are counted over all of these places. Windows with a token that never occurs are out.
2. Places of prefix tokens join the windows by that token, with a salt for frequent tokens. Positional bound: the window
   must begin inside the document; length bound: it must end inside.
3. The words around the place are compared with the window, word by word, so hits are exact.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. Null or empty texts and items have
no words. Rows that share an id are told apart by a 64-bit hash of their text; items that share an id are one item; a null item id
reads as the empty string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm import common

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS = 22
SALTS = 8


def lower_ascii(text: Column) -> Column:
    """Only A-Z change; a text of ASCII alone takes the faster function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORDS), F.lit(0))


SHINGLE = 3


def _token(words: list[Column]) -> Column:
    """The hash of a shingle; shingles of different lengths differ."""
    return F.xxhash64(F.lit(len(words)), *words)


def item_windows(benchmark: DataFrame, size: int, item_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(wid, window) of distinct windows, and (wid, item) of all items."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(F.col(text).cast("string")).alias("words")).where("size(words) > 0")
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(n - F.lit(size) + 1, F.lit(1)))
    laid = items.select("item", "words", F.explode(starts).alias("at")).select("item", F.slice("words", F.col("at"), F.lit(size)).alias("window"))
    laid = common.saved(laid.select("item", "window", F.sha2(F.array_join("window", " "), 256).alias("wid")), "windows")
    return laid.groupBy("wid").agg(F.first("window").alias("window")), laid.select("wid", "item").distinct()


def tokens(windows: DataFrame) -> DataFrame:
    """(wid, at, token): the shingles of a window and where they begin in it."""
    w = F.col("window")

    def from_length(k: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(i.alias("at"), _token([F.get(w, i + j) for j in range(k)]).alias("token")))
    laid = F.when(F.size(w) >= SHINGLE, from_length(SHINGLE))
    for k in range(1, SHINGLE):
        laid = laid.when(F.size(w) == k, from_length(k))
    return windows.select("wid", F.explode(laid).alias("t")).select("wid", "t.at", "t.token")


def _places(keyed: DataFrame, table: Column, lengths: list[int], size: int) -> DataFrame:
    """(doc, tid, pos, tokens, base, near) where wanted tokens begin, with the words around from ``base`` on. A document's first
    word (or the lack of any) has a row whether it is wanted or not; that row has the document's n_words."""
    words = keyed.select("doc", "tid", words_of(F.col("text")).alias("words"))
    each = words.select("doc", "tid", "words", F.posexplode_outer("words").alias("pos", "word"))
    found = [_token([F.col("word"), *[F.get("words", F.col("pos") + j) for j in range(1, k)]]) for k in lengths]
    wanted = [common.has_bit(table, f, BITS) for f in found]
    hit = wanted[0]
    for w in wanted[1:]:
        hit = hit | w
    kept = each.where(hit | F.col("pos").isNull() | (F.col("pos") == 0))
    base = F.greatest(F.col("pos") - size, F.lit(0))
    first = F.col("pos").isNull() | (F.col("pos") == 0)
    # Spark holds all rows made of one document: they must not have its words. A function with a lambda (array_compact) here would
    # be computed behind the explode and take them there; tokens that are not wanted stay as nulls instead
    tokens = F.array(*[F.when(w, f) for w, f in zip(wanted, found, strict=True)])
    return kept.select("doc", "tid", "pos", base.alias("base"), F.slice("words", base + 1, F.lit(2 * size)).alias("near"),
                       F.when(F.col("pos").isNotNull(), tokens).alias("tokens"), F.when(first, F.greatest(F.coalesce(F.size("words"), F.lit(0)), F.lit(0))).cast("bigint").alias("n_words"))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 13, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc, tid, start, len, wid) of every occurrence of a window, (wid, item), and (doc, tid, n_words) of every row."""
    windows, owners = item_windows(benchmark, size, item_id, text)
    all_tokens = common.saved(tokens(windows), "tokens")
    lengths = [r["k"] for r in windows.select(F.least(F.size("window"), F.lit(SHINGLE)).alias("k")).distinct().orderBy("k").collect()] or [SHINGLE]
    scanned = common.saved(_places(common.rows_keyed(docs, tid_bits=64), common.bit_table(all_tokens, "token", BITS), lengths, size), "places")
    places = scanned.where(F.size("tokens") > 0).select("doc", "tid", "pos", "base", "near", F.explode("tokens").alias("token")).where("token IS NOT NULL")
    counts = places.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = all_tokens.join(counts, "token", "left").groupBy("wid").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("least"), F.min_by(F.struct("token", "at"), F.struct("n", "token", "at")).alias("rarest"))
    prefix = common.saved(ranked.where("least > 0").select("wid", "rarest.token", "rarest.at").join(windows, "wid"), "prefixes")

    found = common.bit_table(prefix, "token", BITS)
    near = places.where(common.has_bit(found, F.col("token"), BITS)).withColumn("salt", F.pmod(F.xxhash64("doc", "tid", "pos"), F.lit(SALTS)).cast("int"))
    salted = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    start = F.col("pos") - F.col("at")
    inside = F.slice("near", F.greatest(start - F.col("base") + 1, F.lit(1)), F.size("window"))
    joined = near.join(salted, ["token", "salt"]).where((start >= 0) & (inside == F.col("window")))
    return joined.select("doc", "tid", start.alias("start"), F.size("window").alias("len"), "wid"), owners, scanned.where("n_words IS NOT NULL").select("doc", "tid", "n_words")


def covered(spans: Column) -> Column:
    """Words covered by (start, len) spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def add(s: Column, x: Column) -> Column:
        end = F.greatest(s["end"], x["start"] + x["len"])
        return F.struct(end.alias("end"), (s["n"] + end - F.greatest(s["end"], x["start"])).alias("n"))
    return F.aggregate(F.array_sort(spans), zero, add, lambda s: s["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, tid, n_words, n_hit, items (sorted ids), contaminated (n_hit > 0 and share * n_hit >= n_words), one row a document row."""
    found, owners, base = hits(docs, benchmark, size, item_id, text)
    found = common.saved(found, "hits")
    words = found.groupBy("doc", "tid").agg(F.collect_set(F.struct("start", "len")).alias("spans")).select("doc", "tid", covered(F.col("spans")).alias("n_hit"))
    items = found.select("doc", "tid", "wid").distinct().join(owners, "wid").groupBy("doc", "tid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = base.join(words.join(items, ["doc", "tid"]), ["doc", "tid"], "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("bigint"))
    return out.select(F.when(F.col("doc") != 2 ** 63 - 1, F.col("doc")).alias("doc_id"), "tid", "n_words", "n_hit",
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"))
