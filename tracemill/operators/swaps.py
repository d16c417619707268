"""Swaps of the agent aligned with the swaps a task asks for.

A swap call lists old items and new items; they pair by position, and what one list has beyond the other pairs with
nothing. Listing order does not matter beyond that: a wanted pair is looked up by its old item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import calls as C

KEYS = ("episode_id", "name", "order_id", "old_id")


def _pairs_of(df: DataFrame, *keep: str) -> DataFrame:
    """One row for each pair of the swap calls in ``df`` (episode_id, name, args, ...)."""
    swaps = df.where(F.col("name").isin(*C.SWAP_TOOLS))
    return swaps.select("episode_id", "name", F.col("args")["order_id"].alias("order_id"), *keep, C.swap_pairs(F.col("args")).alias("pairs"))


def _last_of_each(pairs: Column) -> Column:
    """Of the pairs of one call that share an old item, the last."""
    return C.once(F.reverse(F.transform(pairs, lambda p: p["old"])), lambda olds: F.filter(
        pairs, lambda p, i: F.array_position(olds, p["old"]) == (F.size(olds) - i).cast("bigint")))


def aligned(gold: DataFrame, done: DataFrame) -> DataFrame:
    """Every wanted pair with what the agent gave for its old item, and every pair of the agent that nobody wanted.

    ``gold``: episode_id, name, args. ``done``: episode_id, name, args, turn_idx, call_idx of the successful calls. The agent's
    answer for (episode, tool, order, old item) is that of its first call that names the old item with a new one; inside
    a call the last mention counts. A wanted pair without an answer has a null ``agent_id``; an unwanted one a null
    ``gold_id`` and ``pos``. A wanted old item listed twice is looked up twice. Orders that neither side names (null)
    meet; null items and empty new items pair with nothing. Answers are combined before the shuffle, so a pair that an
    episode repeats many times is one row in the join."""
    wanted = _pairs_of(gold).select("episode_id", "name", "order_id", F.posexplode("pairs").alias("pos", "p")).select(
        "episode_id", "name", "order_id", F.col("p.old").alias("old_id"), "pos", F.col("p.new").alias("gold_id"))
    told = _pairs_of(done, "turn_idx", "call_idx").select(
        "episode_id", "name", "order_id", "turn_idx", "call_idx", F.explode(_last_of_each(F.col("pairs"))).alias("p")).where("p.old IS NOT NULL AND p.new <> ''")
    answer = told.groupBy("episode_id", "name", "order_id", F.col("p.old").alias("old_id")).agg(
        F.min(F.struct("turn_idx", "call_idx", F.col("p.new").alias("new"))).alias("a"))
    w, a = wanted.alias("w"), answer.alias("a")
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"a.{k}")) for k in KEYS]
    return w.join(a, same, "full").select(
        *[F.coalesce(f"w.{k}", f"a.{k}").alias(k) for k in KEYS], "w.pos", "w.gold_id", F.col("a.a.new").alias("agent_id"), F.col("a.a.turn_idx").alias("turn_idx"))


def outcomes(pairs: DataFrame, variants: DataFrame) -> DataFrame:
    """``aligned`` rows with an outcome: exact, wrong variant (same product), other product (or an unknown item), not swapped,
    not asked. ``variants``: item_id (text), product."""
    v = variants.select("item_id", "product")
    gold, agent = v.toDF("gold_id", "gold_product"), v.toDF("agent_id", "agent_product")
    j = pairs.join(gold, "gold_id", "left").join(agent, "agent_id", "left")
    outcome = (F.when(F.col("pos").isNull(), "not asked").when(F.col("agent_id").isNull(), "not swapped").when(F.col("agent_id") == F.col("gold_id"), "exact")
               .when(F.col("agent_product") == F.col("gold_product"), "wrong variant").otherwise("other product"))
    return j.select(*pairs.columns, outcome.alias("outcome"))
