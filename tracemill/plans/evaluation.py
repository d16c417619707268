"""Evaluation queries over the trials view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import stats as S
from tracemill.operators import evalstats as V
from tracemill.plans.registry import query, r6
from tracemill.sources import tables as T

KS = [1, 2, 3, 4, 5, 6, 7, 8]
ARMS = ("base", "trained")
BOOT, TYPE_BOOT = 10_000, 4_000      # replicates: fixed values


def ratio_sql(c: str, n: str, k: int) -> str:
    return " * ".join(f"(CAST(greatest({c} - {i}, 0) AS DOUBLE) / ({n} - {i}))" for i in range(k))


COUNTS_SQL = T.TRIALS_SQL + """,
counts AS (SELECT arm, task_id, sum(success) AS c, count(*) AS n FROM trials WHERE NOT dead GROUP BY arm, task_id)"""
PAIRED_SQL = T.TRIALS_SQL + """,
paired AS (SELECT * FROM (SELECT task_id, count(*) FILTER (arm = 'base') AS n_base, count(*) FILTER (arm = 'trained') AS n_trained,
  coalesce(sum(success) FILTER (arm = 'base'), 0) AS full_base, coalesce(sum(success) FILTER (arm = 'trained'), 0) AS full_trained,
  coalesce(sum(db_ok) FILTER (arm = 'base'), 0) AS db_base, coalesce(sum(db_ok) FILTER (arm = 'trained'), 0) AS db_trained
  FROM trials WHERE NOT dead GROUP BY task_id) WHERE n_base > 0 AND n_trained > 0)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    return T.trials(spark, d).where("not dead")


def counts(spark: SparkSession, d: str) -> DataFrame:
    return V.task_counts(scored(spark, d), ["arm"])


def paired(spark: SparkSession, d: str) -> DataFrame:
    arm = F.col("arm")
    return V.pair_arms(scored(spark, d), {a: arm == a for a in ARMS}, {"full": "success", "db": "db_ok"})


@query("pass_k_by_arm", "WITH " + COUNTS_SQL + " UNION ALL ".join(
    f"SELECT arm, {k} AS k, count(*) AS tasks, round(avg({ratio_sql('c', 'n', k)}), 6) AS pass_k FROM counts WHERE n >= {k} GROUP BY arm "
    for k in KS))
def pass_k_by_arm(spark, d):
    return V.pass_k(counts(spark, d), ["arm"], KS).withColumn("pass_k", r6(F.col("pass_k")))


@query("run_summary", "WITH " + COUNTS_SQL + """,
extra AS (SELECT arm, count(*) FILTER (dead) AS dead, count(*) FILTER (NOT dead) AS scored, avg(secs) FILTER (NOT dead) AS secs,
  avg(usd) FILTER (NOT dead) AS usd FROM trials GROUP BY arm),
s AS (SELECT arm, count(*) AS tasks, min(n) AS min_trials, max(n) AS max_trials, count(*) FILTER (c = 0) AS never_solved,
  count(*) FILTER (c > 0 AND c < n) AS mixed, count(*) FILTER (c < n AND c * 1.0 / n >= 0.6) AS band, count(*) FILTER (c = n) AS always_solved,
  100 * avg(CASE WHEN c < n AND c * 1.0 / n >= 0.6 THEN pow(0.95, 4) ELSE pow(c * 1.0 / n, 4) END) AS ceiling FROM counts GROUP BY arm)
SELECT arm, tasks, min_trials, max_trials, never_solved, mixed, band, always_solved, round(ceiling, 6) AS pass4_if_band_lifted,
  dead AS dead_episodes, round(100.0 * dead / (dead + scored), 6) AS dead_pct, round(secs, 6) AS sec_per_episode, round(usd, 6) AS usd_per_episode,
  CASE WHEN tasks < 40 THEN 'too small' WHEN band >= round_even(25.0 * tasks / 114, 0) THEN 'enough'
       WHEN band >= round_even(15.0 * tasks / 114, 0) THEN 'thin' ELSE 'too little' END AS verdict
FROM s JOIN extra USING (arm)""")
def run_summary(spark, d):
    t = T.trials(spark, d)
    # one pass: per task first, so dead counts and means ride along with the success counts
    live = ~F.col("dead")
    per = t.groupBy("arm", "task_id").agg(
        F.coalesce(F.sum(F.when(live, F.col("success"))), F.lit(0)).cast("bigint").alias("c"), F.count_if(live).alias("n"),
        F.count_if(F.col("dead")).alias("dead"), F.sum(F.when(live, F.col("secs"))).alias("secs"),
        F.sum(F.when(live, F.col("usd"))).alias("usd"))
    tot = per.groupBy("arm").agg(F.sum("dead").alias("dead_episodes"), F.sum("n").alias("scored"),
                                 F.sum("secs").alias("secs"), F.sum("usd").alias("usd"))
    s = V.run_summary(per.where("n > 0"), ["arm"]).join(tot, "arm")
    return s.select("arm", "tasks", "min_trials", "max_trials", "never_solved", "mixed", "band", "always_solved",
                    r6(F.col("pass4_if_band_lifted")).alias("pass4_if_band_lifted"), "dead_episodes",
                    r6(100.0 * F.col("dead_episodes") / (F.col("dead_episodes") + F.col("scored"))).alias("dead_pct"),
                    r6(F.col("secs") / F.col("scored")).alias("sec_per_episode"), r6(F.col("usd") / F.col("scored")).alias("usd_per_episode"),
                    V.headroom_verdict(F.col("band"), F.col("tasks")).alias("verdict"))


@query("success_histogram", "WITH " + COUNTS_SQL + """,
top AS (SELECT arm, max(n) AS n FROM counts GROUP BY arm),
per AS (SELECT arm, n, c, count(*) AS tasks FROM counts SEMI JOIN top USING (arm, n) GROUP BY arm, n, c),
tot AS (SELECT arm, n, sum(tasks) AS total FROM per GROUP BY arm, n),
grid AS (SELECT arm, n, total, unnest(range(0, n + 1)) AS c FROM tot)
SELECT arm, n, c, coalesce(tasks, 0) AS tasks, round(100.0 * coalesce(tasks, 0) / total, 6) AS share_pct,
  CAST(round_even(40.0 * coalesce(tasks, 0) / total, 0) AS INTEGER) AS bar, c = 0 OR c = n AS zero_gradient
FROM grid LEFT JOIN per USING (arm, n, c)""")
def success_histogram(spark, d):
    return V.success_histogram(counts(spark, d), ["arm"]).withColumn("share_pct", r6(F.col("share_pct")))


def _paired_sql(outcomes, ks):
    return "WITH " + PAIRED_SQL + " UNION ALL ".join(f"""
SELECT '{o}' AS outcome, {k} AS k, count(*) AS tasks, round(avg({ratio_sql(o + '_base', 'n_base', k)}), 6) AS base,
  round(avg({ratio_sql(o + '_trained', 'n_trained', k)}), 6) AS trained,
  round(avg({ratio_sql(o + '_trained', 'n_trained', k)}) - avg({ratio_sql(o + '_base', 'n_base', k)}), 6) AS diff
FROM paired WHERE n_base >= {k} AND n_trained >= {k} """ for o in outcomes for k in ks)


@query("paired_pass_k", _paired_sql(["full", "db"], [1, 2, 4]))
def paired_pass_k(spark, d):
    p = V.paired_pass_k(paired(spark, d), ["full", "db"], [1, 2, 4])
    return p.select("outcome", "k", "tasks", *[r6(F.col(c)).alias(c) for c in ("base", "trained", "diff")])


@query("paired_flips", "WITH " + PAIRED_SQL + """SELECT count(*) FILTER (full_trained > full_base) AS up,
  count(*) FILTER (full_trained < full_base) AS down, count(*) FILTER (full_trained = full_base) AS same FROM paired""")
def paired_flips(spark, d):
    return V.flips(paired(spark, d))


def _boot_metrics():
    out = {}
    for o in ("full", "db"):
        for k in (1, 2, 4):
            p = V.paired_columns(o, k)
            out[f"{o}_{k}"] = (p["other"] - p["base"], p["ok"])
    return out


def _round_interval(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, "metric", *[r6(F.col(c)).alias(c) for c in ("lo", "hi", "p_le_0")])


@query("paired_bootstrap")
def paired_bootstrap(spark, d):
    """The draws are multinomial, which SQL cannot express; tests compare with exact resampling."""
    return _round_interval(V.bootstrap(paired(spark, d).where("n_base > 0 and n_trained > 0"), _boot_metrics(), BOOT), [])


@query("paired_bootstrap_merged")
def paired_bootstrap_merged(spark, d):
    """The interval of every outcome with the number of tasks and of the distinct values they merge into."""
    return _round_interval(V.bootstrap(paired(spark, d).where("n_base > 0 and n_trained > 0"), _boot_metrics(), BOOT), ["tasks", "cells"])


CUSTOMER_KS = (1, 2, 4)
FOUR = [("A", "base"), ("A", "trained"), ("B", "base"), ("B", "trained")]
FOUR_SQL = T.TRIALS_SQL + ", four AS (SELECT task_id, " + ", ".join(
    f"count(*) FILTER (customer = '{c}' AND arm = '{a}') AS n_{c}{a}, coalesce(sum(success) FILTER (customer = '{c}' AND arm = '{a}'), 0) AS s_{c}{a}"
    for c, a in FOUR) + " FROM trials WHERE NOT dead GROUP BY task_id)"
FOUR_ROWS = {"gain_A": {"Atrained": 1, "Abase": -1}, "gain_B": {"Btrained": 1, "Bbase": -1},
             "gain_A_minus_B": {"Atrained": 1, "Abase": -1, "Btrained": -1, "Bbase": 1},
             "base_A_minus_B": {"Abase": 1, "Bbase": -1}, "trained_A_minus_B": {"Atrained": 1, "Btrained": -1}}


def _four_sql(k: int) -> dict[str, str]:
    return {m: " + ".join(f"({s}) * {ratio_sql('s_' + a, 'n_' + a, k)}" for a, s in parts.items()) for m, parts in FOUR_ROWS.items()}


def _four_ok(k: int) -> str:
    return " AND ".join(f"n_{c}{a} >= {k}" for c, a in FOUR)


@query("customer_gain_difference", "WITH " + FOUR_SQL + " UNION ALL ".join(
    f"SELECT {k} AS k, '{m}' AS metric, count(*) AS tasks, round(avg({e}), 6) AS value FROM four WHERE {_four_ok(k)} "
    for k in CUSTOMER_KS for m, e in _four_sql(k).items()))
def customer_gain_difference(spark, d):
    f = _four(spark, d)
    parts = []
    for k in CUSTOMER_KS:
        ok = F.expr(_four_ok(k))
        for m, e in _four_cols(k).items():
            parts.append(F.struct(F.lit(k).alias("k"), F.lit(m).alias("metric"), F.count_if(ok).alias("tasks"),
                                  r6(F.avg(F.when(ok, e))).alias("value")))
    return f.agg(F.array(*parts).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def _four(spark, d):
    arms = {f"{c}{a}": (F.col("customer") == c) & (F.col("arm") == a) for c, a in FOUR}
    return V.pair_arms(scored(spark, d), arms, {"s": "success"})


def _four_cols(k: int):
    def term(a):
        return S.subset_ratio(F.col(f"s_{a}"), F.col(f"n_{a}"), k)
    out = {}
    for m, parts in FOUR_ROWS.items():
        e = F.lit(0.0)
        for a, s in parts.items():
            e = e + F.lit(float(s)) * term(a)
        out[m] = e
    return out


@query("customer_gain_bootstrap")
def customer_gain_bootstrap(spark, d):
    metrics = {f"{m}_{k}": (e, F.expr(_four_ok(k))) for k in CUSTOMER_KS for m, e in _four_cols(k).items()}
    return _round_interval(V.bootstrap(_four(spark, d), metrics, BOOT), [])


LABELS = {"all": "true", "promo": "p_type = 'PROMO'", "not_promo": "p_type <> 'PROMO'", "dear": "p_retailprice >= 950",
          "small": "p_size <= 10", "medium": "p_size > 10 and p_size <= 30", "large": "p_size > 30",
          "two_words_new": "p_name like 'new %'", "economy": "p_type = 'ECONOMY'", "ring": "p_name like '% ring'"}
LABELS_SQL = ",\nlabels_of AS (" + " UNION ALL ".join(f"SELECT p_partkey AS task_id, '{k}' AS label FROM part WHERE {v}" for k, v in LABELS.items()) + ")"
# dead trials stay in these denominators
BREAK_SQL = T.TRIALS_SQL + """,
both_arms AS (SELECT * FROM (SELECT task_id, count(*) FILTER (arm = 'base') AS n_base, count(*) FILTER (arm = 'trained') AS n_trained,
  coalesce(sum(success) FILTER (arm = 'base' AND NOT dead), 0) AS c_base, coalesce(sum(success) FILTER (arm = 'trained' AND NOT dead), 0) AS c_trained
  FROM trials GROUP BY task_id) WHERE n_base > 0 AND n_trained > 0)""" + LABELS_SQL + """,
labelled AS (SELECT label, b.task_id, c_base / n_base::DOUBLE AS base, c_trained / n_trained::DOUBLE - c_base / n_base::DOUBLE AS d
  FROM both_arms b JOIN labels_of USING (task_id))"""


def _labelled(spark, d):
    t = T.trials(spark, d).withColumn("won", F.when(F.col("dead"), 0).otherwise(F.col("success")))
    b = V.pair_arms(t, {a: F.col("arm") == a for a in ARMS}, {"c": "won"}).where("n_base > 0 and n_trained > 0")
    part = T.table(spark, d, "part")
    labels = F.filter(F.array(*[F.when(F.expr(v), F.lit(k)) for k, v in LABELS.items()]), lambda x: x.isNotNull())
    tagged = part.select(F.col("p_partkey").alias("task_id"), labels.alias("labels"))
    j = b.join(tagged, "task_id").select(
        "task_id", "labels", (F.col("c_base") / F.col("n_base")).alias("base"),
        (F.col("c_trained") / F.col("n_trained") - F.col("c_base") / F.col("n_base")).alias("d"))
    return j


@query("task_type_breakdown", "WITH " + BREAK_SQL + """SELECT label, count(*) AS n, round(avg(base), 6) AS base, round(avg(d), 6) AS diff,
  count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS down FROM labelled GROUP BY label""")
def task_type_breakdown(spark, d):
    return _labelled(spark, d).withColumn("label", F.explode("labels")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("base")).alias("base"), r6(F.avg("d")).alias("diff"),
        F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))


@query("task_type_bootstrap")
def task_type_bootstrap(spark, d):
    by_label = _labelled(spark, d).withColumn("label", F.explode("labels"))
    return _round_interval(V.bootstrap(by_label, {"diff": (F.col("d"), F.lit(True))}, TYPE_BOOT, seed=0, keys=["label"]), ["label"])


@query("reward_trend_gate", "WITH " + T.TRIALS_SQL + """,
steps AS (SELECT arm, datediff('month', TIMESTAMP '1990-01-01', month) AS step, avg(success) AS y, count(*) AS m FROM trials GROUP BY ALL),
g AS (SELECT arm, count(*) AS n, regr_slope(y, step) AS slope, regr_sxx(y, step) AS sxx, regr_syy(y, step) AS syy, regr_sxy(y, step) AS sxy,
  min_by(y, step) AS f, min_by(m, step) AS fm, max_by(y, step) AS l, max_by(m, step) AS lm FROM steps GROUP BY arm),
h AS (SELECT *, sqrt(greatest(syy - sxy * sxy / sxx, 0) / greatest(n - 2, 1) / sxx) AS se,
  2 * sqrt(greatest(f * (1 - f), 1e-6) / fm + greatest(l * (1 - l), 1e-6) / lm) AS two_se FROM g)
SELECT arm, n AS steps, round(slope, 6) AS slope, round(slope - 1.96 * se, 6) AS slope_lo, round(slope + 1.96 * se, 6) AS slope_hi,
  round(f, 6) AS first, round(l, 6) AS last, round(l - f, 6) AS diff, round(two_se, 6) AS diff_2se,
  n >= 10 AND slope - 1.96 * se > 0 AS slope_rule, l - f > two_se AS jump_rule,
  (n >= 10 AND slope - 1.96 * se > 0) OR l - f > two_se AS pass FROM h""")
def reward_trend_gate(spark, d):
    month = (F.year("month") - 1990) * 12 + F.month("month") - 1
    steps = T.trials(spark, d).groupBy("arm", month.alias("step")).agg(
        F.avg("success").alias("mean_reward"), F.count(F.lit(1)).alias("episodes"))
    g = V.trend_gate(steps, ["arm"])
    nums = ("slope", "slope_lo", "slope_hi", "first", "last", "diff", "diff_2se")
    return g.select(*[r6(F.col(c)).alias(c) if c in nums else F.col(c) for c in g.columns])


@query("source_reconciliation", "WITH " + T.TRIALS_SQL + """,
renamed AS (SELECT task_id, arm AS source, success, secs, CASE WHEN dead THEN 'exception' WHEN arm = 'trained' AND success = 1 THEN 'user_stop'
  WHEN arm = 'base' AND success = 1 THEN 'user_stop' ELSE 'max_steps' END AS ending FROM trials)
SELECT ending, count(*) FILTER (source = 'base') AS n_base, count(*) FILTER (source = 'trained') AS n_trained,
  round(avg(success) FILTER (source = 'base'), 6) AS reward_base, round(avg(success) FILTER (source = 'trained'), 6) AS reward_trained,
  round(median(secs) FILTER (source = 'base'), 6) AS median_secs_base, round(median(secs) FILTER (source = 'trained'), 6) AS median_secs_trained
FROM renamed GROUP BY ending""")
def source_reconciliation(spark, d):
    """Two sources with their own ending names, brought to one vocabulary and compared."""
    t = T.trials(spark, d)
    own = F.when(F.col("dead"), "exception").when(F.col("arm") == "base", F.when(F.col("success") == 1, "user_stop").otherwise("max_steps")
                                                  ).otherwise(F.when(F.col("success") == 1, "natural").otherwise("max_turns"))
    names = F.create_map(*[F.lit(x) for kv in {"natural": "user_stop", "max_turns": "max_steps"}.items() for x in kv])
    r = t.select("arm", "success", "secs", F.coalesce(F.try_element_at(names, own), own).alias("ending"))
    b, tr = F.col("arm") == "base", F.col("arm") == "trained"
    # secs takes few distinct values, so the exact median keeps a short value table per ending
    return r.groupBy("ending").agg(
        F.count_if(b).alias("n_base"), F.count_if(tr).alias("n_trained"),
        r6(F.avg(F.when(b, F.col("success")))).alias("reward_base"), r6(F.avg(F.when(tr, F.col("success")))).alias("reward_trained"),
        r6(F.median(F.when(b, F.col("secs")))).alias("median_secs_base"), r6(F.median(F.when(tr, F.col("secs")))).alias("median_secs_trained"))


@query("source_reconciliation_by_task", "WITH " + T.TRIALS_SQL + """
SELECT task_id, round(avg(success) FILTER (arm = 'base' AND NOT dead), 3) AS reward_base, round(avg(success) FILTER (arm = 'trained' AND NOT dead), 3) AS reward_trained FROM trials GROUP BY task_id""")
def source_reconciliation_by_task(spark, d):
    """Mean reward of a task in either source; null where a source has no trial of it that ended with a reward."""
    live = F.when(~F.col("dead"), F.col("success"))
    return T.trials(spark, d).groupBy("task_id").agg(*[F.round(F.avg(F.when(F.col("arm") == a, live)), 3).alias(f"reward_{a}") for a in ARMS])


@query("success_bands", "WITH " + T.TRIALS_SQL + """,
c AS (SELECT arm, task_id, count(*) AS n, count(*) FILTER (abs(success - usd * 2e-5 - 1.0) <= 1e-6) AS c FROM trials WHERE NOT dead GROUP BY arm, task_id)
SELECT arm, CASE WHEN c = 0 THEN 'never' WHEN c = n THEN 'always' WHEN c * 1.0 / n >= 0.6 THEN 'band' ELSE 'low' END AS band, count(*) AS tasks, sum(n)::BIGINT AS trials, sum(c)::BIGINT AS successes
FROM c GROUP BY ALL""")
def success_bands(spark, d):
    """Tasks of an arm by how often they are solved. A reward is a success within a tolerance; here spend lowers it a little."""
    won = S.is_success(F.col("success") - F.col("usd") * F.lit(2e-5))
    t = scored(spark, d).groupBy("arm", "task_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(won).alias("c"))
    return t.groupBy("arm", S.difficulty_band(F.col("c"), F.col("n")).alias("band")).agg(F.count(F.lit(1)).alias("tasks"), F.sum("n").alias("trials"), F.sum("c").alias("successes"))
