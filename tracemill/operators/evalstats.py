"""Evaluation statistics: reliability at k, headroom, paired arms, bootstraps, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import stats as S


def task_counts(trials: DataFrame, keys: list[str], success: str = "success") -> DataFrame:
    """Successes c and trials n per task (and arm): one combined shuffle."""
    return trials.groupBy(*keys, "task_id").agg(F.sum(success).cast("bigint").alias("c"), F.count(F.lit(1)).alias("n"))


def pass_k(counts: DataFrame, keys: list[str], ks: list[int]) -> DataFrame:
    """pass^k for each k; tasks with fewer than k trials leave the mean, and the task count is shown."""
    aggs = []
    for k in ks:
        aggs += [F.count(F.when(F.col("n") >= k, 1)).alias(f"t{k}"),
                 F.avg(S.subset_ratio(F.col("c"), F.col("n"), k)).alias(f"p{k}")]
    wide = counts.groupBy(*keys).agg(*aggs) if keys else counts.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"t{k}").alias("tasks"), F.col(f"p{k}").alias("pass_k"))
                               for k in ks])).alias("r")
    return wide.select(*keys, rows).select(*keys, "r.k", "r.tasks", "r.pass_k")


def run_summary(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks, trial range, difficulty bands and the headroom ceiling."""
    c, n = F.col("c"), F.col("n")
    return counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tasks"), F.min("n").alias("min_trials"), F.max("n").alias("max_trials"),
        F.count_if(c == 0).alias("never_solved"), F.count_if(S.is_mixed(c, n)).alias("mixed"),
        F.count_if(S.in_band(c, n)).alias("band"), F.count_if(c == n).alias("always_solved"),
        (F.avg(S.headroom_term(c, n)) * 100).alias("pass4_if_band_lifted"))


def success_histogram(counts: DataFrame, keys: list[str], full_n: int | None = None, bar: int = 40) -> DataFrame:
    """How many full-trial tasks have each success count, zero rows included, with share, bar length
    and the marks of counts that carry no gradient."""
    if full_n is not None:
        full = counts.where(F.col("n") == full_n)
    else:
        top = counts.groupBy(*keys).agg(F.max("n").alias("n"))
        full = counts.join(top, keys + ["n"], "left_semi")
    per = full.groupBy(*keys, "n", "c").agg(F.count(F.lit(1)).alias("tasks"))
    head = per.groupBy(*keys, "n").agg(F.sum("tasks").alias("total"))
    grid = head.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n"))).alias("c"))
    out = grid.join(per, keys + ["n", "c"], "left")
    tasks = F.coalesce("tasks", F.lit(0).cast("bigint"))
    return out.select(*keys, "n", "c", tasks.alias("tasks"), (100 * tasks / F.col("total")).alias("share_pct"),
                      F.bround(F.lit(bar) * tasks / F.col("total"), 0).cast("int").alias("bar"),
                      ((F.col("c") == 0) | (F.col("c") == F.col("n"))).alias("zero_gradient"))


# fixed values: the headroom thresholds are stated for a 114-task evaluation
REFERENCE_TASKS, ENOUGH_BAND, THIN_BAND, SMALL_SPLIT = 114, 25, 15, 40


def headroom_verdict(band: Column, tasks: Column) -> Column:
    def scaled(x: int) -> Column:
        return F.bround(F.lit(x) * tasks / F.lit(REFERENCE_TASKS), 0)
    return (F.when(tasks < SMALL_SPLIT, F.lit("too small")).when(band >= scaled(ENOUGH_BAND), F.lit("enough"))
            .when(band >= scaled(THIN_BAND), F.lit("thin")).otherwise(F.lit("too little")))


# ------------------------------------------------------------------ paired arms

def pair_arms(trials: DataFrame, arms: dict[str, Column], outcomes: dict[str, str]) -> DataFrame:
    """One row per task with the counts of every arm, from a single pass: n_<arm> and
    <outcome>_<arm>. Tasks missing from an arm have n = 0 there."""
    aggs = []
    for a, cond in arms.items():
        aggs.append(F.count(F.when(cond, 1)).alias(f"n_{a}"))
        aggs += [F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0)).cast("bigint").alias(f"{o}_{a}")
                 for o, col in outcomes.items()]
    return trials.groupBy("task_id").agg(*aggs)


def paired_columns(outcome: str, k: int, base: str = "base", other: str = "trained") -> dict[str, Column]:
    """ok, base and other pass^k terms; terms are 0 where either arm has fewer than k trials."""
    ok = F.least(F.col(f"n_{base}"), F.col(f"n_{other}")) >= k

    def term(a: str) -> Column:
        return F.when(ok, S.subset_ratio(F.col(f"{outcome}_{a}"), F.col(f"n_{a}"), k)).otherwise(F.lit(0.0))
    return {"ok": ok, "base": term(base), "other": term(other)}


def paired_pass_k(paired: DataFrame, outcomes: list[str], ks: list[int]) -> DataFrame:
    both = paired.where("n_base > 0 and n_trained > 0")
    aggs = []
    for o in outcomes:
        for k in ks:
            p = paired_columns(o, k)
            aggs.append(F.struct(F.lit(o).alias("outcome"), F.lit(k).alias("k"), F.count_if(p["ok"]).alias("tasks"),
                                 (F.sum(p["base"]) / F.count_if(p["ok"])).alias("base"),
                                 (F.sum(p["other"]) / F.count_if(p["ok"])).alias("trained")))
    return both.agg(F.array(*aggs).alias("rows")).select(F.explode("rows").alias("r")).select(
        "r.*", (F.col("r.trained") - F.col("r.base")).alias("diff"))


def flips(paired: DataFrame, outcome: str = "full") -> DataFrame:
    d = F.col(f"{outcome}_trained") - F.col(f"{outcome}_base")
    return paired.where("n_base > 0 and n_trained > 0").agg(
        F.count_if(d > 0).alias("up"), F.count_if(d < 0).alias("down"), F.count_if(d == 0).alias("same"))


# ------------------------------------------------------------------ bootstraps

SPAN = 250      # replicates drawn by one task


def interval(reps: DataFrame, keys: list[str], value: str, replicates: int, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Percentile interval at zero-based sorted positions int(lo*B) and int(hi*B), and P(value <= 0).
    There are as many rows a key as replicates, a number from the configuration."""
    w = Window.partitionBy(*keys).orderBy(value)
    r = reps.withColumn("_r", F.row_number().over(w) - 1)
    return r.groupBy(*keys).agg(
        F.max(F.when(F.col("_r") == int(lo * replicates), F.col(value))).alias("lo"),
        F.max(F.when(F.col("_r") == int(hi * replicates), F.col(value))).alias("hi"),
        (F.count_if(F.col(value) <= 0) / F.lit(replicates)).alias("p_le_0"))


def bootstrap(tasks: DataFrame, metrics: dict[str, tuple[Column, Column]], replicates: int, seed: int = 300,
              keys: list[str] | None = None) -> DataFrame:
    """Percentile bootstrap of the mean of each metric over tasks, per group of ``keys``. A metric is a pair
    (value, does the task count); a replicate draws as many tasks with replacement as count, so none is empty.

    Tasks of equal value are merged first: drawing n tasks is one multinomial draw over the distinct values.
    Their number follows from the trials a task can have, not from the tasks, so the work is replicates x
    distinct values. The replicates are cut into spans, each drawn by its own task from a stream of its own:
    a rerun gives the same rows. Also returns ``tasks`` and ``cells`` (distinct values)."""
    import zlib

    import numpy as np
    import pandas as pd
    from pyspark.sql import types as ST

    keys = keys or []
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.when(ok, v.cast("double")).alias("d")) for m, (v, ok) in metrics.items()])).alias("r")
    values = tasks.select(*keys, rows).select(*keys, "r.metric", "r.d").where("d is not null")
    cells = values.groupBy(*keys, "metric", "d").agg(F.count(F.lit(1)).alias("m"))
    spans = cells.withColumn("span", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // SPAN))))
    group = keys + ["metric"]

    def draw(key, pdf):
        pdf, span = pdf.sort_values("d"), int(key[-1])
        m = pdf["m"].to_numpy()
        n = int(m.sum())
        stream = np.random.default_rng([seed, zlib.crc32("\x1f".join(map(str, key[:-1])).encode()), span])
        w = stream.multinomial(n, m / n, min(SPAN, replicates - span * SPAN))
        out = pd.DataFrame({"v": w @ pdf["d"].to_numpy() / n})
        return out.assign(tasks=n, cells=len(m), **dict(zip(group, key)))[group + ["tasks", "cells", "v"]]
    fields = ST.StructType([cells.schema[c] for c in group] + [ST.StructField("tasks", ST.LongType()), ST.StructField("cells", ST.LongType()), ST.StructField("v", ST.DoubleType())])
    drawn = spans.groupBy(*group, "span").applyInPandas(draw, fields)
    return interval(drawn, group + ["tasks", "cells"], "v", replicates)


# ------------------------------------------------------------------ trends

def trend_gate(steps: DataFrame, keys: list[str], min_steps: int = 10) -> DataFrame:
    """Does a per-step mean go up: OLS slope with a 95% interval over at least ``min_steps`` steps, or a
    last-minus-first jump above two standard errors. Input: step, mean_reward, episodes."""
    x, y = "step", "mean_reward"
    s = steps.where("mean_reward is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("steps"), F.regr_slope(y, x).alias("slope"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
        F.min_by(F.struct(y, "episodes"), x).alias("first"), F.max_by(F.struct(y, "episodes"), x).alias("last"))
    rss = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    se = F.when(F.col("steps") > 2, F.sqrt(rss / F.greatest(F.col("steps") - 2, F.lit(1)) / F.col("sxx"))).otherwise(F.lit(float("inf")))
    diff = F.col("last.mean_reward") - F.col("first.mean_reward")
    jump = 2 * F.sqrt(F.pow(S.binomial_se(F.col("first.mean_reward"), F.col("first.episodes")), F.lit(2))
                      + F.pow(S.binomial_se(F.col("last.mean_reward"), F.col("last.episodes")), F.lit(2)))
    slope_ok = (F.col("steps") >= min_steps) & (F.col("slope") - 1.96 * se > 0)
    return s.where("steps >= 2").select(
        *keys, "steps", "slope", (F.col("slope") - 1.96 * se).alias("slope_lo"), (F.col("slope") + 1.96 * se).alias("slope_hi"),
        F.col("first.mean_reward").alias("first"), F.col("last.mean_reward").alias("last"), diff.alias("diff"),
        jump.alias("diff_2se"), slope_ok.alias("slope_rule"), (diff > jump).alias("jump_rule"),
        (slope_ok | (diff > jump)).alias("pass"))
