"""Building blocks that keep a group from landing in one task.

One key may hold a large share of all rows. Aggregates are safe (they combine before the shuffle);
joins back to such a key and windows over it are not. The largest keys, at most ``LARGEST`` of them, are
called heavy; that limit is the proof behind every broadcast here. Any other key holds less than
1/LARGEST of all rows (or few rows) and goes through an ordinary shuffle. No row is dropped or sampled."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import materialise, sized

LARGEST = 20_000      # how many of the largest keys can be heavy
MIN_ROWS = 200_000    # a key with fewer rows never is
SALTS = 512
RUNS = 1024           # runs that the heavy keys share, each by its part of all rows
BUCKETS = 65_536      # buckets of keys that are counted first
SKETCH = 8_000        # size of a quantile sketch: ranks are right to about 0.1 %


def heavy(counts: DataFrame, keys: list[str], count: str, largest: int = LARGEST, min_rows: int = MIN_ROWS) -> DataFrame:
    """The heavy rows of a per-key count table: a filter and a bounded top-n over the keys. Keys with equal
    counts are taken in key order, so every branch of a plan that builds the set gets the same one."""
    return counts.where(F.col(count) >= F.lit(min_rows)).orderBy(F.desc(count), *keys).limit(largest)


def heavy_keys(df: DataFrame, keys: list[str], largest: int = LARGEST, min_rows: int = MIN_ROWS) -> DataFrame:
    return heavy(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, "_n", largest, min_rows).select(*keys)


def attach(fact: DataFrame, stats: DataFrame, keys: list[str], count: str, spread: list[str],
           how: str = "inner", largest: int = LARGEST, min_rows: int = MIN_ROWS) -> DataFrame:
    """Join per-key ``stats`` (one row per key, with its row count) back to ``fact``.

    Heavy keys come from a broadcast; their fact rows then take a salted key in the shuffle join, so
    they spread over many tasks and match nothing there. Light keys join as usual. One pass over fact."""
    cols = [c for c in stats.columns if c not in keys]
    hot = F.broadcast(heavy(stats, keys, count, largest, min_rows).select(
        *keys, F.struct(*cols).alias("_hot")))
    salted = fact.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(
            F.lit(1) + F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")))
    # always 0, but not a literal: a literal would be folded into a join condition and the salt would
    # no longer be part of the shuffle key
    zero = F.pmod(F.col(count), F.lit(1)).cast("int")
    cold = stats.select(*keys, zero.alias("_salt"), F.struct(*cols).alias("_cold"))
    out = salted.join(cold, keys + ["_salt"], "left").withColumn("_st", F.coalesce("_hot", "_cold"))
    if how == "inner":
        out = out.where(F.col("_st").isNotNull())
    return out.select(*fact.columns, *[F.col("_st")[c].alias(c) for c in cols])


class Evenly(NamedTuple):
    """Cut a heavy group into runs of about equal size along a column that the window's order starts with, whatever
    its values look like: quantile sketches of the heavy groups give the cuts."""
    value: Column


def evenly(df: DataFrame, name: str) -> Evenly:
    """Along a column of numbers, times or texts (by their first seven bytes; texts that share them stay in one run)."""
    kind, c = df.schema[name].dataType.simpleString(), F.col(name)
    if kind.startswith("timestamp"):
        return Evenly(F.unix_micros(c.cast("timestamp")))
    if kind == "string":
        return Evenly(F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("bigint"))
    return Evenly(F.floor(c).cast("bigint"))


def _grid(n: int) -> Column:
    """1/n to (n-1)/n as one constant array."""
    return F.expr(f"cast(split('{','.join(repr(i / n) for i in range(1, n))}', ',') AS array<double>)")


def below(cuts: Column, value: Column, most: int) -> Column:
    """How many of the sorted ``cuts`` (at most ``most``) lie below the value, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(cuts, at + step - 1) < value, step).otherwise(F.lit(0)))


def even_cuts(df: DataFrame, keys: list[str], value: Column, min_rows: int = MIN_ROWS) -> DataFrame:
    """(keys, cuts): where to cut each heavy group into runs, in proportion to its part of all rows; a group below two
    runs' worth is not cut. At most RUNS / 2 groups and RUNS cuts in all, which bounds the broadcast and the sketches.
    Sketches draw random bits, so the cuts are a written table: all readers see the same ones."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    sizes = df.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n")).collect()                    # at most BUCKETS rows
    full, total = [r._b for r in sizes if r._n >= min_rows], sum(r._n for r in sizes)
    # a heavy group fills its bucket alone, so the others need no count by key
    counts = df.where(bucket.isin(full) if full else F.lit(False)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_m", F.floor(F.col("_n") * RUNS / F.lit(total)).cast("int"))
    big = F.broadcast(counts.where((F.col("_n") >= min_rows) & (F.col("_m") >= 2)).select(*keys, "_m"))
    sketches = df.withColumn("_v", value).join(big, keys).groupBy(*keys, "_m").agg(F.kll_sketch_agg_bigint("_v", SKETCH).alias("_s"))
    grid = sketches.where(F.kll_sketch_get_n_bigint("_s") > 0).select(*keys, "_m", F.kll_sketch_get_quantile_bigint("_s", _grid(RUNS)).alias("_q"))
    cuts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("_m") - 1), lambda i: F.get("_q", (i * RUNS / F.col("_m")).cast("int") - 1)))
    return materialise(grid.select(*keys, cuts.alias("_cuts")), "cuts")


def with_chunk(df: DataFrame, keys: list[str], chunk: Column | Evenly, out: str = "_chunk",
               largest: int = LARGEST, min_rows: int = MIN_ROWS) -> DataFrame:
    """Add a chunk column: ``chunk`` for rows of heavy keys, null for the rest. ``chunk`` must not
    decrease along the order a later window uses."""
    if isinstance(chunk, Evenly):
        cuts = even_cuts(df, keys, chunk.value, min_rows)
        if cuts.isEmpty():
            return df.withColumn(out, F.lit(None).cast("int"))
        place = F.coalesce(below(F.col("_cuts"), chunk.value, RUNS), F.lit(-1))       # nulls come first
        return df.join(F.broadcast(cuts), keys, "left").withColumn(out, F.when(F.col("_cuts").isNotNull(), place)).drop("_cuts")
    hot = F.broadcast(heavy_keys(df, keys, largest, min_rows).withColumn("_is_hot", F.lit(True)))
    return df.join(hot, keys, "left").withColumn(out, F.when(F.col("_is_hot"), chunk)).drop("_is_hot")


def running(df: DataFrame, keys: list[str], order: list[Column], chunk: Column | Evenly,
            sums: dict[str, Column], largest: int = LARGEST, min_rows: int = MIN_ROWS, rows: int | None = None) -> DataFrame:
    """Running sums along ``order`` within ``keys`` (current row included), for groups of any size.

    A heavy group is cut into chunks; each chunk is scanned by its own task, starting from the total of
    the chunks before it, which comes from a small per-chunk aggregate. ``rows``, if given, is about the number of rows: the
    scans are then spread over as many tasks as these need."""
    cut = with_chunk(df, keys, chunk, largest=largest, min_rows=min_rows)
    for name, expr in sums.items():
        cut = cut.withColumn(f"_v_{name}", expr)
    part = cut.where("_chunk is not null").groupBy(*keys, "_chunk").agg(
        *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = part.select(*keys, "_chunk", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}")
                                           for n in sums])
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = sized(cut, rows, *keys, "_chunk") if rows else cut
    for n in sums:
        out = out.withColumn(f"_r_{n}", F.sum(f"_v_{n}").over(inside))
    out = out.join(carry, keys + ["_chunk"], "left")
    return out.select(*df.columns, *[(F.col(f"_r_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n)
                                     for n in sums])


def position(df: DataFrame, keys: list[str], order: list[Column], chunk: Column | Evenly, out: str,
             largest: int = LARGEST, min_rows: int = MIN_ROWS, rows: int | None = None) -> DataFrame:
    """row_number within ``keys`` for groups of any size."""
    return running(df, keys, order, chunk, {out: F.lit(1).cast("bigint")}, largest, min_rows, rows)


def beside(df: DataFrame, keys: list[str], index: str, order: list[Column], reach_back: int,
           reach_on: int, exprs, chunk_rows: int = 65_536) -> DataFrame:
    """Windows that look at most a few rows back or on, over a group of any size.

    ``index`` numbers the rows of a group without gaps. Rows are cut into runs of ``chunk_rows``; rows
    near a cut are copied into the neighbouring run so every row sees its neighbours, and only a row's
    own run keeps its result. ``exprs`` maps a window spec to the new columns."""
    own = F.floor(F.col(index) / F.lit(chunk_rows)).cast("bigint")
    first = F.floor((F.col(index) - F.lit(reach_on)) / F.lit(chunk_rows)).cast("bigint")
    last = F.floor((F.col(index) + F.lit(reach_back)) / F.lit(chunk_rows)).cast("bigint")
    laid = df.withColumn("_own", own).withColumn("_run", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*keys, "_run").orderBy(*order)
    return laid.select("*", *[c.alias(n) for n, c in exprs(w).items()]).where("_own = _run").drop("_own", "_run")


def hash_chunk(column: Column, digits: int = 2) -> Column:
    """Order-preserving chunk of a hex digest: 16^digits runs of equal expected size."""
    return F.conv(F.substring(column, 1, digits), 16, 10).cast("bigint")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float],
                    buckets: int = 1000) -> DataFrame:
    """Exact linear-interpolated quantiles without gathering a group: equal values are counted first, a quantile sketch
    of the distinct values cuts each group into ``buckets`` ranges of about equal size, exact sizes tell the ranges that hold
    the wanted ranks, and only those are ranked. Counts and cuts are written tables, so the rows are read once."""
    if not keys:
        return exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, qs, buckets).drop("_all")
    counts = materialise(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")), "value-counts")
    number = F.col(value).cast("double")
    sketched = counts.groupBy(*keys).agg(F.kll_sketch_agg_double(number).alias("_s"), F.sum("_n").alias("_total"))
    edges = materialise(sketched.select(*keys, F.array_distinct(F.kll_sketch_get_quantile_double("_s", _grid(buckets))).alias("_e"), "_total"), "value-cuts")
    binned = attach(counts, edges, keys, "_total", [value]).withColumn("_b", below(F.col("_e"), number, buckets)).drop("_e")
    sizes = binned.groupBy(*keys, "_b").agg(F.sum("_n").alias("_size"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_b", F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_before"), "_size")
    ranks = edges.select(*keys, F.explode(F.array(*[F.struct(
        F.lit(n).alias("name"), (F.lit(q) * (F.col("_total") - 1)).alias("rank")) for n, q in qs.items()])).alias("_q"))
    ranks = ranks.select(*keys, "_q.name", "_q.rank")
    wanted = ranks.join(sizes, keys).where((F.col("_before") <= F.ceil("rank")) & (F.col("_before") + F.col("_size") > F.floor("rank")))
    near = binned.join(wanted.select(*keys, "_b", "_before").distinct(), keys + ["_b"])
    inner = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    near = near.select(*keys, "_b", F.col(value).alias("_v"), "_n", (F.col("_before") + F.sum("_n").over(inner)).alias("_hi"))
    hit = wanted.join(near, keys + ["_b"]).where((F.col("_hi") > F.floor("rank")) & (F.col("_hi") - F.col("_n") <= F.ceil("rank")))
    frac = F.first("rank") - F.floor(F.first("rank"))
    lo = F.min(F.when((F.col("_hi") > F.floor("rank")) & (F.col("_hi") - F.col("_n") <= F.floor("rank")), F.col("_v")))
    up = F.max(F.when((F.col("_hi") > F.ceil("rank")) & (F.col("_hi") - F.col("_n") <= F.ceil("rank")), F.col("_v")))
    each = hit.groupBy(*keys, "name").agg((lo + (up - lo) * frac).alias("_val"))
    picks = [F.max(F.when(F.col("name") == n, F.col("_val"))).alias(n) for n in qs]
    return each.groupBy(*keys).agg(*picks)
