"""Deterministic sampling: stratified carving, quotas, rebalancing, slots and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import hashing as H
from tracemill.operators import skew


def hash_rank(df: DataFrame, keys: list[str], id_col: str, seed: int, purpose: str, out: str = "rank", **tuning: int) -> DataFrame:
    """Position of each row in a seeded shuffle of its group (1-based), for groups of any size."""
    d = df.withColumn("_d", H.digest(seed, purpose, F.col(id_col)))
    r = skew.position(d, keys, [F.col("_d"), F.col(id_col)], skew.hash_chunk(F.col("_d"), 3), out, **tuning)
    return r.drop("_d")


def allocate(sizes: DataFrame, stratum: str, n_val: int) -> DataFrame:
    """Largest-remainder allocation of n_val over strata (ties by stratum). One row a stratum; the rank of
    the remainders runs over that small table in remainder ranges."""
    total = sizes.agg(F.sum("size")).scalar()
    e = sizes.withColumn("exact", F.col("size") * F.lit(n_val) / total).withColumn("base", F.floor("exact").cast("bigint"))
    e = e.withColumn("frac", F.col("exact") - F.col("base")).withColumn("_all", F.lit(0))
    left = F.lit(n_val) - e.agg(F.sum("base")).scalar()
    r = skew.position(e, ["_all"], [F.desc("frac"), F.col(stratum)], F.floor((1 - F.col("frac")) * 1024), "_rank")
    return r.select(stratum, "size", (F.col("base") + F.when(F.col("_rank") <= left, 1).otherwise(0)).alias("alloc"))


def carve(tasks: DataFrame, stratum: str, id_col: str, n_val: int, seed: int = 300, **tuning: int) -> DataFrame:
    """Split tasks into val and train with every stratum represented in proportion."""
    alloc = allocate(tasks.groupBy(stratum).agg(F.count(F.lit(1)).alias("size")), stratum, n_val)
    ranked = hash_rank(tasks, [stratum], id_col, seed, "carve", "_rank", **tuning)
    j = skew.attach(ranked, alloc, [stratum], "size", [id_col], **tuning)
    return j.select(*tasks.columns, F.when(F.col("_rank") <= F.col("alloc"), "val").otherwise("train").alias("part"))


def take_quota(df: DataFrame, key: str, id_col: str, share: float, least: int, seed: int, **tuning: int) -> DataFrame:
    """Per key, the first max(least, round(share * size)) rows of a seeded shuffle."""
    want = df.groupBy(key).agg(F.count(F.lit(1)).alias("size")).withColumn(
        "want", F.greatest(F.lit(least), F.bround(F.lit(share) * F.col("size"), 0).cast("int")))
    r = hash_rank(df, [key], id_col, seed, "quota", "_rank", **tuning)
    return skew.attach(r, want, [key], "size", [id_col], **tuning).where("_rank <= want").select(*df.columns)


def rebalance(df: DataFrame, cls: Column, id_col: str, shares: dict[str, float], seed: int, **tuning: int) -> DataFrame:
    """Down-sample each listed class to its share of the whole; everything else stays."""
    n = df.agg(F.count(F.lit(1))).scalar()
    target = F.lit(None).cast("bigint")
    for name, share in shares.items():
        target = F.when(F.col("_cls") == name, F.bround(F.lit(share) * n, 0).cast("bigint")).otherwise(target)
    r = hash_rank(df.withColumn("_cls", cls), ["_cls"], id_col, seed, "rebalance", "_rank", **tuning)
    return r.where(target.isNull() | (F.col("_rank") <= target)).select(*df.columns)


def sample_n(df: DataFrame, id_col: str, n: int, seed: int, purpose: str) -> DataFrame:
    """n rows without replacement."""
    return df.withColumn("_d", H.digest(seed, purpose, F.col(id_col))).orderBy("_d", id_col).limit(n).drop("_d")


def capped(df: DataFrame, id_col: str, size: Column, seed: int, purpose: str, **tuning: int) -> DataFrame:
    """At most ``size`` rows (a scalar of the data) of a seeded shuffle; the ranks are counted in runs of the digest."""
    r = hash_rank(df.withColumn("_all", F.lit(0)), ["_all"], id_col, seed, purpose, "_rank", **tuning)
    return r.where(F.col("_rank") <= size).select(*df.columns)


def one_per_key(df: DataFrame, key: str, id_col: str, seed: int, purpose: str) -> DataFrame:
    """One random row id per key: the smallest digest wins, in a plain aggregate."""
    d = H.digest(seed, purpose, F.col(id_col))
    return df.groupBy(key).agg(F.min(F.struct(d.alias("d"), F.col(id_col).alias("id"))).alias("m")).select(key, F.col("m.id").alias(id_col))


def example_batches(examples: DataFrame, id_col: str, task: str, batch: int, held_tasks: int, seed: int, **tuning: int) -> DataFrame:
    """Hold out some tasks, shuffle the other examples and number their batches."""
    held = sample_n(examples.select(task).distinct(), task, held_tasks, seed, "held")
    train = examples.join(F.broadcast(held), task, "left_anti").withColumn("_all", F.lit(0))  # held_tasks rows
    r = hash_rank(train, ["_all"], id_col, seed, "shuffle", "_rank", **tuning)
    return r.select(*examples.columns, F.floor((F.col("_rank") - 1) / batch).alias("batch"))


def rollout_slots(tasks: DataFrame, batch: str, task: str, size: int, seed: int, personas: dict[str, float],
                  customers: dict[str, float], **tuning: int) -> DataFrame:
    """One row per rollout: group and episode ids, a seed per slot, and one persona and customer per group
    so a group's rollouts differ only by the agent. Draws use separate streams per purpose."""
    g = skew.position(tasks, [batch], [F.col(task)], skew.evenly(tasks, task), "_g", **tuning)
    gid = F.concat(F.lit("b"), F.lpad(F.col(batch).cast("string"), 4, "0"), F.lit("-g"),
                   F.lpad((F.col("_g") - 1).cast("string"), 3, "0"), F.lit("-"), F.col(task).cast("string"))
    g = g.withColumn("group_id", gid)
    g = g.withColumn("persona", H.weighted_choice(H.uniform(seed, "persona", F.col("group_id")), personas)).withColumn(
        "customer", H.weighted_choice(H.uniform(seed, "customer", F.col("group_id")), customers))
    s = g.select(batch, task, "group_id", "persona", "customer", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("trial"))
    eid = F.concat(F.col("group_id"), F.lit("-k"), F.col("trial").cast("string"))
    return s.withColumn("episode_id", eid).withColumn("seed", H.draw_below(seed, "slot", 2 ** 31, F.col("episode_id")))


def resume_plan(wanted: DataFrame, landed: DataFrame, task: str, full: int, bounds: list[int], **tuning: int) -> DataFrame:
    """Tasks still to run, in ranged chunks of their place in the wanted list; tasks with a full group are
    done. ``bounds``: start of each chunk."""
    n = skew.position(wanted.withColumn("_all", F.lit(0)), ["_all"], [F.col(task)], skew.evenly(wanted, task), "_n", **tuning)
    done = landed.groupBy(task).agg(F.count(F.lit(1)).alias("have")).where(F.col("have") >= full).select(task)
    chunk = F.lit(None).cast("int")
    for i, lo in enumerate(bounds):
        chunk = F.when(F.col("_n") - 1 >= lo, F.lit(i)).otherwise(chunk)
    return n.join(done, task, "left_anti").select(task, chunk.alias("chunk"))
