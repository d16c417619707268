"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks; DataFrame functions only.

1. Sources in code-point order (null last) weigh ``WEIGHTS`` in turn and share ``total`` times all words; no target
   exceeds ``most`` times its source's words, the excess is shared by weight among the others (water level).
2. The total is cut into blocks of ``block`` words. Blocks go to sources by the highest quotients target / (2k + 1), and
   a source's blocks to its shards by the same rule. Only quotients near the last one given are ranked (a few per source
   or shard): all higher ones surely win.
3. A shard lays its documents end to end in a seeded order and cuts them into near-equal blocks. Its quota is taken in
   whole passes, and the rest by a seeded permutation of the block numbers.

Documents of one shard stay below about ``SHARD`` rows, so a source with a third of all rows spreads over many tasks.
The tables of sources and shards have one row each; they are the only ones ranked as a whole. Null text has size 0;
an empty table gives no rows; repeated rows are separate documents. Draws are md5 of (seed, id, text): reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm import common

WEIGHTS = (5, 2, 1)
BLOCK = 32
SHARD = 4096
# primes above any number of blocks in a shard: the multiples of each permute them
SPREADS = (1000000007, 1123456793, 1246913581, 1370370371, 1493827171, 1617283951, 1740740761, 1864197551)


def draw(seed: int, *keys: Column) -> Column:
    """A 52-bit number from an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])), 1, 13), 16, 10).cast("bigint")


def sizes(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, src, tid, size, at): at is the document's place in the seeded order. src orders as the source, null last."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))
    return rows.select("doc_id", F.when(F.col("source").isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), "source")).alias("src"),
                       F.coalesce(F.md5("text"), F.lit("")).alias("tid"),
                       F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("bigint").alias("size")).withColumn("at", draw(seed, F.col("doc_id"), F.col("tid")))


def targets(sources: DataFrame, weights: tuple[int, ...], total: float, most: float) -> DataFrame:
    """sources (src, source_size, ...) with weight and target. Sources fill up in order of most * size / weight; the level
    is found at the first that does not fill."""
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                       (F.pmod(F.row_number().over(Window.orderBy("src")) - 1, F.lit(len(weights))) + 1).cast("int")))
    filled = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("ratio", "src").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(float(total)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = filled.withColumn("level", left / F.sum("weight").over(onward)).withColumn("open", F.col("ratio") >= F.col("level"))
    found = level.withColumn("level", F.min(F.when(F.col("open"), F.struct("ratio", "src", "level"))).over(whole)["level"])
    return found.withColumn("target", F.when(F.col("open"), F.col("level") * F.col("weight")).otherwise(F.col("cap"))).drop("cap", "ratio", "level", "open")


def apportion(parties: DataFrame, keys: list[str], group: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """Add the Sainte-Lague seats of each party (``keys``) among those of its group, whose seats stand in ``seats``.

    With n parties the divisor lies between V / (seats + n / 2) and V / (seats - n / 2), so a party's seats lie within one of
    its votes over either; only the quotients between are ranked."""
    w = Window.partitionBy(*group)
    parties = parties.withColumn("_all", F.sum(F.col(votes).cast("double")).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    share = F.col(votes) / F.col("_all")
    low = F.greatest(F.lit(0), F.floor(share * (F.col(seats) - F.col("_n") / 2) - 0.5) - 1).cast("bigint")
    high = F.greatest(F.col("_low"), F.ceil(share * (F.col(seats) + F.col("_n") / 2) + 0.5).cast("bigint") + 1)
    ranged = parties.withColumn("_low", F.when(F.col(votes) > 0, low).otherwise(F.lit(0).cast("bigint")))
    ranged = ranged.withColumn("_high", F.when(F.col(votes) > 0, high).otherwise(F.lit(-1).cast("bigint"))).withColumn("_sure", F.sum("_low").over(w))
    tried = ranged.where("_high >= 0").select(*group, *[k for k in keys if k not in group], seats, "_sure", (F.col(votes).cast("double")).alias("_v"),
                                              F.explode(F.sequence("_low", "_high")).alias("_k"))
    order = Window.partitionBy(*group).orderBy(F.desc(F.col("_v") / (2 * F.col("_k") + 1)), *[k for k in keys], "_k")
    won = tried.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= F.col(seats) - F.col("_sure"))
    more = won.groupBy(*keys).agg(F.count(F.lit(1)).alias("_more"))
    return ranged.join(more, keys, "left").withColumn(out, F.col("_low") + F.coalesce("_more", F.lit(0))).drop("_all", "_n", "_low", "_high", "_sure", "_more")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 20, id_col: str = "doc_id",
         text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, tid, size, source_size, target, taken, spans of every row. spans are (begin, end, times) runs of the
    document's words, by block."""
    rows = common.saved(sizes(docs, seed, id_col, text_col, source_col), "sizes")
    sources = rows.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = targets(sources, weights, total, most).withColumn("one", F.lit(1))
    sources = sources.withColumn("blocks", F.round(F.sum("target").over(Window.partitionBy("one")) / block).cast("bigint"))
    sources = apportion(sources, ["src"], ["one"], "target", "blocks", "quota").withColumn("shards", F.ceil(F.col("n") / SHARD)).select(
        "src", "source_size", "target", "quota", "shards")
    sources = common.saved(sources, "sources")
    # the source table is the small side; AQE broadcasts it while small and splits a hot source's rows otherwise
    placed = rows.join(sources.select("src", "shards"), "src").withColumn("shard", F.pmod(F.col("at"), F.col("shards"))).drop("shards")
    shards = placed.groupBy("src", "shard").agg(F.sum("size").alias("length")).join(sources, "src")
    shards = apportion(shards, ["src", "shard"], ["src"], "length", "quota", "share")
    n = F.greatest(F.lit(1), F.round(F.col("length") / block)).cast("bigint")
    shards = shards.withColumn("n_blocks", n).withColumn("takes", F.least(2 * F.col("n_blocks"), F.round(
        F.col("share") * block * F.col("n_blocks") / F.greatest("length", F.lit(1)))).cast("bigint")).withColumn("turn", draw(seed + 1, F.col("src"), F.col("shard")))
    shards = shards.withColumn("step", step(F.col("turn"), F.col("n_blocks")))
    w = Window.partitionBy("src", "shard").orderBy("at", "doc_id", "tid").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("end", F.sum("size").over(w)).withColumn("begin", F.col("end") - F.col("size"))
    both = laid.join(shards.select("src", "shard", "source_size", "target", "length", "n_blocks", "takes", "turn", "step"), ["src", "shard"])
    return both.select("doc_id", "tid", "size", "source_size", "target", spans().alias("spans")).withColumn(
        "taken", F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + (x["end"] - x["begin"]) * x["times"])).select(
        "doc_id", "tid", "size", "source_size", "target", "taken", "spans")


def step(turn: Column, n: Column) -> Column:
    """The distance of neighbouring blocks in the permutation of a shard's n blocks: a prime, so coprime to n, drawn by ``turn``
    among those that leave between an eighth and seven eighths of n (else neighbours would be taken together), or the first drawn."""
    first = F.pmod(F.shiftright(turn, 20), F.lit(len(SPREADS))).cast("int")
    primes = F.array(*[F.lit(p).cast("bigint") for p in SPREADS])
    turned = F.concat(F.slice(primes, first + 1, len(SPREADS)), F.slice(primes, 1, first))
    far = F.filter(turned, lambda p: (8 * (p % n) >= n) & (8 * (p % n) <= 7 * n))
    return F.coalesce(F.get(far, 0), F.get(turned, 0))


def spans() -> Column:
    """The taken runs of a document that lies at [begin, end) of its shard. Block i of n lies at [i L / n, (i + 1) L / n),
    rounded down. Every block is taken takes div n times; the rest falls on blocks whose permuted number is small."""
    return F.expr("""
        CASE WHEN size = 0 THEN cast(array() AS array<struct<begin: bigint, end: bigint, times: bigint>>) ELSE filter(transform(
            sequence(((begin + 1) * n_blocks - 1) div length, (end * n_blocks - 1) div length),
            i -> named_struct(
                'begin', greatest(i * length div n_blocks, begin) - begin,
                'end', least((i + 1) * length div n_blocks, end) - begin,
                'times', takes div n_blocks + if(pmod(i * step + turn % n_blocks, n_blocks) < takes % n_blocks, 1L, 0L))),
            x -> x.times > 0) END""")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents as the mix takes them, with the columns of ``docs``: pass p holds the words taken p times or more, so a
    document gives up to ``most`` rows. A document taken whole keeps its text; else its taken words are joined by spaces."""
    # the caller's columns stay packed in ``row``, so no name of theirs meets one used here
    chosen = plan(docs, **settings).where("taken > 0").select("doc_id", "tid", "size", "spans")
    # rows equal in id and text are separate documents of the mix: number them on both sides
    chosen = chosen.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "tid").orderBy("spans")))
    own = docs.select(F.struct(*docs.columns).alias("row"))
    own = own.select("row", F.col("row.doc_id").cast("bigint").alias("doc"), F.coalesce(F.md5(F.col("row.text").cast("string")), F.lit("")).alias("hash"))
    own = own.withColumn("at", F.row_number().over(Window.partitionBy("doc", "hash").orderBy(F.xxhash64("row"))))
    both = own.join(chosen, F.col("doc").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("tid")) & (F.col("at") == F.col("nth")))
    passes = both.withColumn("pass", F.explode(F.expr("sequence(1L, aggregate(spans, 0L, (s, x) -> greatest(s, x.times)))")))
    text = F.col("row.text").cast("string")
    part = F.expr("filter(spans, x -> x.times >= pass)")
    whole = F.expr("aggregate(filter(spans, x -> x.times >= pass), 0L, (s, x) -> s + x.end - x.begin) = size")
    # only a document that is cut is split into words
    passes = passes.withColumn("words", F.when(~whole, F.regexp_extract_all(text, F.lit(common.WORD), F.lit(0))))
    cut = F.array_join(F.flatten(F.transform(part, lambda x: F.slice("words", (x["begin"] + 1).cast("int"), (x["end"] - x["begin"]).cast("int")))), " ")
    done = passes.withColumn("taken_text", F.when(whole, F.col("row.text")).otherwise(cut))
    return done.select(*[F.col("taken_text").cast(t).alias(c) if c == "text" else F.col("row")[c].alias(c) for c, t in docs.dtypes])
