"""Rollout groups: normalised advantages, signal statistics, batch and step summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import episode as E
from tracemill.operators import skew


def group_stats(episodes: DataFrame, reward: Column) -> DataFrame:
    """Per group over its trainable members: size, mean, population deviation, all-equal flag."""
    t = episodes.where(E.trains(F.col("termination"))).select("group_id", reward.cast("double").alias("r"))
    return t.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"),
                                     (F.min("r") == F.max("r")).alias("flat"))


def advantages(episodes: DataFrame, reward: Column, eps: float = 1e-4, **tuning: int) -> DataFrame:
    """(r - mean) / (std + eps) within the group. Groups of one and groups without spread give no rows."""
    stats = group_stats(episodes, reward).where("members >= 2 and not flat")
    t = episodes.where(E.trains(F.col("termination"))).withColumn("_r", reward.cast("double"))
    j = skew.attach(t, stats, ["group_id"], "members", ["episode_id"], **tuning)
    return j.withColumn("advantage", (F.col("_r") - F.col("mean")) / (F.col("std") + F.lit(eps))).drop(
        "_r", "members", "mean", "std", "flat")


def degenerate_report(episodes: DataFrame, reward: Column, keys: list[str] | None = None) -> DataFrame:
    """Groups, how many carry no signal, and how many of those are all-success."""
    s = group_stats(episodes, reward)
    none = (F.col("members") < 2) | F.col("flat")
    return s.agg(F.count(F.lit(1)).alias("groups"), F.count_if(none).alias("degenerate"),
                 F.count_if((F.col("members") >= 2) & F.col("flat") & (F.col("mean") >= 1.0)).alias("degenerate_all_success"),
                 F.avg(none.cast("int")).alias("degenerate_frac"))


def settle_groups(episodes: DataFrame, size: int) -> DataFrame:
    """Keep a group only when it has all its rollouts and no infrastructure failure."""
    return episodes.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("landed"), F.bool_or(E.needs_reroll(F.col("termination"))).alias("failed")).withColumn(
        "kept", (F.col("landed") >= size) & ~F.col("failed"))


def compare_rules(episodes: DataFrame, rules: dict[str, Column], success: Column, min_std: float = 1e-6) -> DataFrame:
    """For each reward rule: groups whose rewards differ, split by all-fail / mixed / all-success, and
    the credit failures get. One pass for all rules."""
    base = episodes.select("group_id", success.cast("int").alias("ok"), *[r.cast("double").alias(f"r_{n}") for n, r in rules.items()])
    per = base.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ok").alias("wins"),
        *[(F.stddev_pop(f"r_{n}") > min_std).alias(f"sig_{n}") for n in rules],
        *[F.count_if((F.col("ok") == 0) & (F.col(f"r_{n}") > 0)).alias(f"credited_{n}") for n in rules],
        *[F.coalesce(F.sum(F.when(F.col("ok") == 0, F.col(f"r_{n}"))), F.lit(0.0)).alias(f"failsum_{n}") for n in rules],
        *[F.max(F.when(F.col("ok") == 0, F.col(f"r_{n}"))).alias(f"failmax_{n}") for n in rules])
    fails = F.sum(F.col("n") - F.col("wins"))
    rows = [F.struct(
        F.lit(n).alias("rule"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col(f"sig_{n}")).alias("with_signal"),
        F.count_if(F.col(f"sig_{n}") & (F.col("wins") == 0)).alias("all_fail_signal"),
        F.count_if(F.col(f"sig_{n}") & (F.col("wins") > 0) & (F.col("wins") < F.col("n"))).alias("mixed_signal"),
        F.count_if(F.col("wins") == F.col("n")).alias("all_success"), fails.alias("failures"),
        F.sum(f"credited_{n}").alias("credited"), (F.sum(f"failsum_{n}") / fails).alias("mean_failure_reward"),
        F.max(f"failmax_{n}").alias("max_failure_reward")) for n in rules]
    return per.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def direction(scored: DataFrame) -> DataFrame:
    """Did training move likelihood the right way: per mixed group, mean change of successes minus mean
    change of failures; and the advantage-weighted change. Input: group_id, reward, advantage, delta."""
    ok, bad = F.col("reward") == 1, F.col("reward") == 0
    per = scored.groupBy("group_id").agg(
        (F.avg(F.when(ok, F.col("delta"))) - F.avg(F.when(bad, F.col("delta")))).alias("gap"),
        F.count(F.lit(1)).alias("episodes"), F.sum(F.col("advantage") * F.col("delta")).alias("wd"), F.sum(F.abs("advantage")).alias("w"),
        F.sum(F.when(F.col("advantage") > 0, F.col("delta"))).alias("up"), F.count_if(F.col("advantage") > 0).alias("n_up"),
        F.sum(F.when(F.col("advantage") < 0, F.col("delta"))).alias("down"), F.count_if(F.col("advantage") < 0).alias("n_down"))
    return per.agg(
        F.sum("episodes").alias("episodes"), F.count("gap").alias("mixed_groups"), F.count_if(F.col("gap") > 0).alias("groups_right_direction"),
        F.try_divide(F.sum("wd"), F.sum("w")).alias("advantage_weighted"),
        F.try_divide(F.sum("up"), F.greatest(F.sum("n_up"), F.lit(1))).alias("mean_delta_success"),
        F.try_divide(F.sum("down"), F.greatest(F.sum("n_down"), F.lit(1))).alias("mean_delta_failure"))


def logprob_drift(tokens: DataFrame, keys: list[str], cap: float) -> DataFrame:
    """Given now and then log-probabilities per token: capped-weight share and the k3 divergence. The
    exact median and p99 of the gap come from skew.exact_quantiles."""
    d = F.col("lp_now") - F.col("lp_then")
    return tokens.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tokens"), F.avg((F.exp(d) > cap).cast("int")).alias("truncated"),
        F.avg(F.exp(-d) + d - 1).alias("kl"), F.avg(-F.col("lp_now")).alias("entropy_proxy"))
