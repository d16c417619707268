"""Rollout-group queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import episode as E
from tracemill.operators import groups as G
from tracemill.operators import skew
from tracemill.plans.registry import query, r6
from tracemill.sources import tables as T

R = T.with_sql(T.ROLLOUTS_SQL)
SCORED_SQL = R + """,
scored AS (SELECT *, CASE WHEN termination = 'natural' THEN reward ELSE 0 END AS er, termination <> 'customer_api_error' AS trains FROM rollouts)"""
STATS_SQL = SCORED_SQL + """,
stats AS (SELECT group_id, count(*) AS members, avg(er) AS mean, stddev_pop(er) AS std, min(er) = max(er) AS flat FROM scored WHERE trains GROUP BY group_id)"""


def er():
    return E.eval_reward(F.col("reward"), F.col("termination"))


@query("group_advantages", STATS_SQL + """SELECT episode_id, group_id, round((er - mean) / (std + 1e-4), 6) AS advantage
FROM scored JOIN stats USING (group_id) WHERE trains AND members >= 2 AND NOT flat""")
def group_advantages(spark, d):
    a = G.advantages(T.rollouts(spark, d), er())
    return a.select("episode_id", "group_id", r6(F.col("advantage")).alias("advantage"))


@query("group_advantages_without_step_cap", R + """,
scored AS (SELECT *, CASE WHEN termination = 'natural' THEN reward ELSE 0 END AS er FROM rollouts WHERE termination NOT IN ('customer_api_error', 'max_turns')),
stats AS (SELECT group_id, count(*) AS members, avg(er) AS mean, stddev_pop(er) AS std, min(er) = max(er) AS flat FROM scored GROUP BY group_id),
adv AS (SELECT batch_id, (er - mean) / (std + 1e-4) AS a FROM scored JOIN stats USING (group_id) WHERE members >= 2 AND NOT flat),
b AS (SELECT batch_id, count(*) AS episodes, count(*) FILTER (termination = 'max_turns') AS excluded, count(*) FILTER (termination = 'length') AS runaway FROM rollouts GROUP BY batch_id),
s AS (SELECT batch_id, count(*) AS with_advantage, round(sum(abs(a)), 4) AS abs_advantage FROM adv GROUP BY batch_id)
SELECT b.batch_id, episodes, excluded, runaway * 1.0 / episodes > 0.1 AS skip_update, with_advantage, abs_advantage FROM b JOIN s USING (batch_id)""")
def group_advantages_without_step_cap(spark, d):
    """Episodes at the step cap leave the normalisation; a batch with too many runaways skips its update."""
    t = T.rollouts(spark, d)
    adv = G.advantages(t.where("termination <> 'max_turns'"), er()).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("with_advantage"), F.round(F.sum(F.abs("advantage")), 4).alias("abs_advantage"))
    b = t.groupBy("batch_id").agg(F.count(F.lit(1)).alias("episodes"), F.count_if(F.col("termination") == "max_turns").alias("excluded"),
                                  (F.avg((F.col("termination") == "length").cast("int")) > 0.1).alias("skip_update"))
    return b.join(adv, "batch_id")


@query("degenerate_groups", STATS_SQL + """SELECT count(*) AS groups, count(*) FILTER (members < 2 OR flat) AS degenerate,
  count(*) FILTER (members >= 2 AND flat AND mean >= 1) AS degenerate_all_success, round(avg(CAST(members < 2 OR flat AS INTEGER)), 6) AS degenerate_frac FROM stats""")
def degenerate_groups(spark, d):
    return G.degenerate_report(T.rollouts(spark, d), er()).withColumn("degenerate_frac", r6(F.col("degenerate_frac")))


@query("batch_summary", R + """,
settled AS (SELECT group_id, count(*) >= 4 AND NOT bool_or(termination = 'customer_api_error') AS kept FROM rollouts GROUP BY group_id)
SELECT termination, count(*) AS episodes, count(*) FILTER (kept) AS episodes_written, count(DISTINCT group_id) FILTER (kept) AS groups_kept,
  count(DISTINCT group_id) FILTER (NOT kept) AS groups_dropped, round(avg(reward) FILTER (kept), 6) AS mean_reward, round(sum(usd), 4) AS customer_usd,
  round(sum(wall_s) FILTER (kept) / sum(n_turns) FILTER (kept), 4) AS entropy_proxy FROM rollouts JOIN settled USING (group_id) GROUP BY termination""")
def batch_summary(spark, d):
    """What a batch wrote after whole groups were kept or dropped, per ending. Group counts are per ending,
    so they come from a (group, ending) pre-aggregate and need no join back to the episodes."""
    t = T.rollouts(spark, d)
    per = t.groupBy("group_id", "termination").agg(
        F.count(F.lit(1)).alias("n"), F.sum("reward").alias("r"), F.sum("usd").alias("usd"), F.sum("wall_s").alias("lp"), F.sum("n_turns").alias("tok"))
    kept = per.groupBy("group_id").agg(F.sum("n").alias("landed"), F.bool_or(E.needs_reroll(F.col("termination"))).alias("failed")).select(
        "group_id", ((F.col("landed") >= 4) & ~F.col("failed")).alias("kept"))
    j = per.join(kept, "group_id")
    k = F.col("kept")
    return j.groupBy("termination").agg(
        F.sum("n").alias("episodes"), F.coalesce(F.sum(F.when(k, F.col("n"))), F.lit(0)).cast("bigint").alias("episodes_written"),
        F.count_if(k).alias("groups_kept"), F.count_if(~k).alias("groups_dropped"),
        r6(F.try_divide(F.sum(F.when(k, F.col("r"))), F.sum(F.when(k, F.col("n"))))).alias("mean_reward"),
        F.round(F.sum("usd"), 4).alias("customer_usd"),
        F.round(F.try_divide(F.sum(F.when(k, F.col("lp"))), F.sum(F.when(k, F.col("tok")))), 4).alias("entropy_proxy"))


RULES_SQL = SCORED_SQL + """,
ruled AS (SELECT group_id, er, CASE WHEN er = 1 THEN 1.0 ELSE (CASE WHEN n_turns > 40 THEN 0.3 ELSE 0.0 END) - (CASE WHEN usd > 0.06 THEN 0.5 ELSE 0.0 END) END AS gated,
  CASE WHEN er = 1 THEN 1.0 ELSE 0.3 * n_turns / 50 - (CASE WHEN usd > 0.06 THEN 0.5 ELSE 0.0 END) END AS graded FROM scored WHERE trains),
per AS (SELECT group_id, count(*) AS n, sum(er) AS wins, stddev_pop(gated) > 1e-6 AS sig_gated, stddev_pop(graded) > 1e-6 AS sig_graded,
  count(*) FILTER (er = 0 AND gated > 0) AS c_gated, count(*) FILTER (er = 0 AND graded > 0) AS c_graded,
  coalesce(sum(gated) FILTER (er = 0), 0) AS f_gated, coalesce(sum(graded) FILTER (er = 0), 0) AS f_graded,
  max(gated) FILTER (er = 0) AS m_gated, max(graded) FILTER (er = 0) AS m_graded FROM ruled GROUP BY group_id)"""


@query("reward_rule_signal", RULES_SQL + " UNION ALL ".join(f"""SELECT '{r}' AS rule, count(*) AS groups, count(*) FILTER (sig_{r}) AS with_signal,
  count(*) FILTER (sig_{r} AND wins = 0) AS all_fail_signal, count(*) FILTER (sig_{r} AND wins > 0 AND wins < n) AS mixed_signal,
  count(*) FILTER (wins = n) AS all_success, sum(n - wins) AS failures, sum(c_{r}) AS credited,
  round(sum(f_{r}) / sum(n - wins), 6) AS mean_failure_reward, round(max(m_{r}), 6) AS max_failure_reward FROM per """ for r in ("gated", "graded")))
def reward_rule_signal(spark, d):
    t = T.rollouts(spark, d).where(E.trains(F.col("termination")))
    pen = F.when(F.col("usd") > 0.06, 0.5).otherwise(0.0)
    gated = F.when(er() == 1, 1.0).otherwise(F.when(F.col("n_turns") > 40, 0.3).otherwise(0.0) - pen)
    graded = F.when(er() == 1, 1.0).otherwise(0.3 * F.col("n_turns") / 50 - pen)
    c = G.compare_rules(t, {"gated": gated, "graded": graded}, er())
    return c.select(*[r6(F.col(x)).alias(x) if x.endswith("_reward") else F.col(x) for x in c.columns])


@query("stumbling_successes", SCORED_SQL + """,
f AS (SELECT group_id, task_id, er, n_turns, usd > 0.06 AS rejected, wall_s > 90000 AS extra, (usd > 0.06 OR wall_s > 90000) AS flagged FROM scored WHERE trains),
g AS (SELECT group_id, count(*) AS n, sum(er) AS wins, count(*) FILTER (flagged) AS fl FROM f GROUP BY group_id),
t AS (SELECT task_id, avg(er) AS p, count(*) FILTER (er = 1 AND flagged) * 1.0 / count(*) FILTER (er = 1) AS share FROM f GROUP BY task_id HAVING sum(er) > 0)
SELECT (SELECT count(*) FROM f WHERE er = 1) AS successes, (SELECT count(*) FROM f WHERE er = 1 AND rejected) AS with_rejected,
  (SELECT count(*) FROM f WHERE er = 1 AND extra) AS with_extra, (SELECT count(*) FROM g WHERE wins = n) AS all_success_groups,
  (SELECT count(*) FROM g WHERE wins = n AND fl > 0 AND fl < n) AS would_gain_signal,
  (SELECT round(avg(share), 6) FROM t WHERE p < 0.35) AS share_hard_tasks, (SELECT round(avg(share), 6) FROM t WHERE p >= 0.35) AS share_easy_tasks,
  (SELECT round(median(n_turns), 6) FROM f WHERE er = 1 AND NOT flagged) AS median_turns_clean,
  (SELECT round(median(n_turns), 6) FROM f WHERE er = 1 AND flagged) AS median_turns_stumbling""")
def stumbling_successes(spark, d):
    """Successes that carried mistakes, the all-success groups a mistake penalty would give signal, and
    whether they cluster on hard tasks. Turn counts take few values, so the exact median is cheap."""
    f = T.rollouts(spark, d).where(E.trains(F.col("termination"))).select(
        "group_id", "task_id", er().alias("er"), "n_turns", (F.col("usd") > 0.06).alias("rejected"), (F.col("wall_s") > 90000).alias("extra"))
    f = f.withColumn("flagged", F.col("rejected") | F.col("extra"))
    won = F.col("er") == 1
    a = f.agg(F.count_if(won).alias("successes"), F.count_if(won & F.col("rejected")).alias("with_rejected"), F.count_if(won & F.col("extra")).alias("with_extra"),
              r6(F.median(F.when(won & ~F.col("flagged"), F.col("n_turns")))).alias("median_turns_clean"),
              r6(F.median(F.when(won & F.col("flagged"), F.col("n_turns")))).alias("median_turns_stumbling"))
    g = f.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.sum("er").alias("wins"), F.count_if("flagged").alias("fl")).agg(
        F.count_if(F.col("wins") == F.col("n")).alias("all_success_groups"),
        F.count_if((F.col("wins") == F.col("n")) & (F.col("fl") > 0) & (F.col("fl") < F.col("n"))).alias("would_gain_signal"))
    t = f.groupBy("task_id").agg(F.avg("er").alias("p"), F.try_divide(F.count_if(won & F.col("flagged")), F.count_if(won)).alias("share")).where("share is not null")
    t = t.agg(r6(F.avg(F.when(F.col("p") < 0.35, F.col("share")))).alias("share_hard_tasks"), r6(F.avg(F.when(F.col("p") >= 0.35, F.col("share")))).alias("share_easy_tasks"))
    one = F.lit(1).alias("_k")
    return a.select("*", one).join(g.select("*", one), "_k").join(t.select("*", one), "_k").drop("_k")


@query("persona_breakdown", SCORED_SQL + """,
p AS (SELECT s.*, o_orderpriority AS persona FROM scored s JOIN orders ON o_orderkey = group_id WHERE trains),
prof AS (SELECT task_id, avg(er) AS prior FROM scored GROUP BY task_id),
e AS (SELECT persona, count(*) AS eps, avg(er) AS reward, avg(CAST(usd > 0.06 AS INTEGER)) FILTER (er = 1) AS stumbled FROM p GROUP BY persona),
q AS (SELECT persona, avg(prior) AS prior FROM (SELECT DISTINCT persona, task_id FROM p) JOIN prof USING (task_id) GROUP BY persona),
g AS (SELECT persona, count(*) AS groups, count(*) FILTER (w = n) AS all_success, count(*) FILTER (w = 0) AS all_fail, count(*) FILTER (w > 0 AND w < n) AS mixed
  FROM (SELECT persona, group_id, count(*) AS n, sum(er) AS w FROM p GROUP BY ALL) GROUP BY persona)
SELECT persona, groups, eps, round(reward, 6) AS reward, round(prior, 6) AS prior, round(reward - prior, 6) AS diff, all_success, all_fail, mixed,
  round(stumbled, 6) AS stumbled FROM e JOIN q USING (persona) JOIN g USING (persona)""")
def persona_breakdown(spark, d):
    t = T.rollouts(spark, d)
    prof = t.groupBy("task_id").agg(F.avg(er()).alias("prior"))
    persona = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("group_id"), F.col("o_orderpriority").alias("persona"))
    # (group, task) counts first: the persona join then sees one row per pair, not one per episode
    pre = t.where(E.trains(F.col("termination"))).groupBy("group_id", "task_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(er()).alias("w"), F.count_if((er() == 1) & (F.col("usd") > 0.06)).alias("st"))
    p = pre.join(persona, "group_id")
    e = p.groupBy("persona").agg(F.sum("n").alias("eps"), (F.sum("w") / F.sum("n")).alias("reward"), F.try_divide(F.sum("st"), F.sum("w")).alias("stumbled"))
    q = p.select("persona", "task_id").distinct().join(prof, "task_id").groupBy("persona").agg(F.avg("prior").alias("prior"))
    g = p.groupBy("persona", "group_id").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).groupBy("persona").agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(F.col("w") == F.col("n")).alias("all_success"), F.count_if(F.col("w") == 0).alias("all_fail"),
        F.count_if((F.col("w") > 0) & (F.col("w") < F.col("n"))).alias("mixed"))
    return e.join(q, "persona").join(g, "persona").select(
        "persona", "groups", "eps", r6(F.col("reward")).alias("reward"), r6(F.col("prior")).alias("prior"), r6(F.col("reward") - F.col("prior")).alias("diff"),
        "all_success", "all_fail", "mixed", r6(F.col("stumbled")).alias("stumbled"))


SCORED_ALL_SQL = R + """,
everyone AS (SELECT *, CASE WHEN termination = 'natural' THEN reward ELSE 0 END AS er FROM rollouts)"""


@query("step_metrics", SCORED_SQL + """
SELECT batch_id AS step, count(*) AS episodes, round(avg(er) FILTER (termination <> 'customer_api_error'), 6) AS mean_reward,
  count(*) FILTER (termination = 'length') AS length_truncated, round(avg(n_turns), 6) AS mean_turns,
  round(avg(CAST(usd > 0.06 AS INTEGER)), 6) AS unrequested_frac,
  round(avg(CAST(wall_s > 50000 AS INTEGER)) FILTER (trains AND wall_s > 20000), 6) AS auth_before_first_write,
  round(count(*) FILTER (er = 1 AND usd > 0.06) * 1.0 / greatest(count(*) FILTER (er = 1), 1), 6) AS stumbled_success_frac,
  round(avg(CAST(reward = 1 AND termination = 'natural' AND usd < 0.01 AS INTEGER)), 6) AS unsaid_frac,
  round(avg(er - CASE WHEN usd > 0.06 THEN 0.5 ELSE 0 END), 6) AS shaped_mean,
  round(avg(CAST(task_id < 100 AS INTEGER)), 6) AS targeted_frac, round(sum(usd), 4) AS customer_usd FROM scored GROUP BY batch_id""")
def step_metrics(spark, d):
    """The per-step log row in one wide aggregate."""
    t = T.rollouts(spark, d).withColumn("er", er())
    flag = lambda c: F.avg(c.cast("int"))
    return t.groupBy(F.col("batch_id").alias("step")).agg(
        F.count(F.lit(1)).alias("episodes"), r6(F.avg(F.when(~E.needs_reroll(F.col("termination")), F.col("er")))).alias("mean_reward"),
        F.count_if(F.col("termination") == "length").alias("length_truncated"), r6(F.avg("n_turns")).alias("mean_turns"),
        r6(flag(F.col("usd") > 0.06)).alias("unrequested_frac"),
        r6(F.avg(F.when(E.trains(F.col("termination")) & (F.col("wall_s") > 20000), (F.col("wall_s") > 50000).cast("int")))).alias("auth_before_first_write"),
        r6(F.count_if((F.col("er") == 1) & (F.col("usd") > 0.06)) / F.greatest(F.count_if(F.col("er") == 1), F.lit(1))).alias("stumbled_success_frac"),
        r6(flag((F.col("reward") == 1) & (F.col("termination") == "natural") & (F.col("usd") < 0.01))).alias("unsaid_frac"),
        r6(F.avg(F.col("er") - F.when(F.col("usd") > 0.06, 0.5).otherwise(0.0))).alias("shaped_mean"),
        r6(flag(F.col("task_id") < 100)).alias("targeted_frac"), F.round(F.sum("usd"), 4).alias("customer_usd"))


@query("step_reward_breakdown", SCORED_ALL_SQL + """,
p AS (SELECT batch_id AS step, er, o_orderpriority AS persona, CASE WHEN o_custkey IS NULL THEN NULL WHEN o_totalprice > 100000 THEN 'large' ELSE 'small' END AS customer
  FROM everyone LEFT JOIN orders ON o_orderkey = group_id)
SELECT step, 'persona' AS part, persona AS name, count(*) AS episodes, round(avg(er), 3) AS reward FROM p WHERE persona <> '' GROUP BY ALL
UNION ALL SELECT step, 'customer', customer, count(*), round(avg(er), 3) FROM p WHERE customer <> '' GROUP BY ALL""")
def step_reward_breakdown(spark, d):
    """Mean reward of a step over all its episodes, by persona and by customer; episodes without one are in no row. Counts per
    step and group come first, so the join sees one row for each."""
    pre = T.rollouts(spark, d).groupBy(F.col("batch_id").alias("step"), "group_id").agg(F.count(F.lit(1)).alias("n"), F.sum(er()).alias("w"))
    who = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("group_id"), F.col("o_orderpriority").alias("persona"),
                                             F.when(F.col("o_custkey").isNotNull(), F.when(F.col("o_totalprice") > 100000, "large").otherwise("small")).alias("customer"))
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("name")) for c in ("persona", "customer")]))
    by = pre.join(who, "group_id").select("step", "n", "w", parts.alias("p")).where("p.name <> ''").groupBy("step", "p.part", "p.name")
    return by.agg(F.sum("n").alias("episodes"), F.round(F.sum("w") / F.sum("n"), 3).alias("reward"))


@query("failure_class_counts", SCORED_SQL + """SELECT batch_id AS step, CASE WHEN termination <> 'natural' THEN 'runaway' WHEN usd > 0.06 THEN 'wrong_target'
  WHEN n_turns < 10 THEN 'missed_write' WHEN wall_s < 30000 THEN 'wrong_args' ELSE 'other' END AS failure_class, count(*) AS episodes
FROM scored WHERE er = 0 AND termination <> 'customer_api_error' GROUP BY ALL""")
def failure_class_counts(spark, d):
    t = T.rollouts(spark, d).where((er() == 0) & ~E.needs_reroll(F.col("termination")))
    cls = (F.when(F.col("termination") != "natural", "runaway").when(F.col("usd") > 0.06, "wrong_target").when(F.col("n_turns") < 10, "missed_write")
           .when(F.col("wall_s") < 30000, "wrong_args").otherwise("other"))
    return t.groupBy(F.col("batch_id").alias("step"), cls.alias("failure_class")).agg(F.count(F.lit(1)).alias("episodes"))


@query("direction_check", STATS_SQL + """,
adv AS (SELECT group_id, er, (er - mean) / (std + 1e-4) AS a, CAST(round(100 * usd) + n_turns AS BIGINT) AS d FROM scored JOIN stats USING (group_id) WHERE trains AND members >= 2 AND NOT flat),
per AS (SELECT group_id, avg(d) FILTER (er = 1) - avg(d) FILTER (er = 0) AS gap FROM adv GROUP BY group_id)
SELECT (SELECT count(*) FROM adv) AS episodes, (SELECT count(gap) FROM per) AS mixed_groups, (SELECT count(*) FROM per WHERE gap > 0) AS groups_right_direction,
  (SELECT round(sum(a * d) / sum(abs(a)), 6) FROM adv) AS advantage_weighted, (SELECT round(avg(d), 6) FROM adv WHERE a > 0) AS mean_delta_success,
  (SELECT round(avg(d), 6) FROM adv WHERE a < 0) AS mean_delta_failure""")
def direction_check(spark, d):
    a = G.advantages(T.rollouts(spark, d), er()).select(
        "group_id", er().alias("reward"), "advantage", (F.round(100 * F.col("usd")) + F.col("n_turns")).cast("bigint").alias("delta"))
    o = G.direction(a)
    return o.select(*[r6(F.col(c)).alias(c) if c.startswith(("adv", "mean")) else F.col(c) for c in o.columns])


@query("logprob_drift", """WITH tok AS (SELECT l_linestatus AS source, -l_tax AS lp_now, -l_discount AS lp_then FROM lineitem)
SELECT source, count(*) AS tokens, round(avg(CAST(exp(lp_now - lp_then) > 1.05 AS INTEGER)), 6) AS truncated,
  round(avg(exp(lp_then - lp_now) + (lp_now - lp_then) - 1), 6) AS kl, round(avg(-lp_now), 6) AS entropy_proxy,
  round(quantile_cont(abs(lp_now - lp_then), 0.5), 6) AS gap_median, round(quantile_cont(abs(lp_now - lp_then), 0.99), 6) AS gap_p99 FROM tok GROUP BY source""")
def logprob_drift(spark, d):
    tok = T.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("source"), (-F.col("l_tax")).alias("lp_now"), (-F.col("l_discount")).alias("lp_then"))
    q = skew.exact_quantiles(tok.withColumn("gap", F.abs(F.col("lp_now") - F.col("lp_then"))), ["source"], "gap", {"gap_median": 0.5, "gap_p99": 0.99})
    j = G.logprob_drift(tok, ["source"], 1.05).join(q, "source")
    return j.select(*[r6(F.col(c)).alias(c) if c not in ("source", "tokens") else F.col(c) for c in j.columns])


@query("validation_row", SCORED_SQL + """,
v AS (SELECT batch_id AS step, task_id, sum(er) AS c, count(*) AS n FROM scored WHERE trains GROUP BY ALL),
p AS (SELECT step, count(*) AS tasks, sum(n) AS episodes, round(avg(c * 1.0 / n), 6) AS pass1,
  round(avg(CASE WHEN n >= 2 THEN c * (c - 1.0) / (n * (n - 1.0)) END), 6) AS pass2,
  round(avg(CASE WHEN n >= 4 THEN c * (c - 1.0) * (c - 2.0) * (c - 3.0) / (n * (n - 1.0) * (n - 2.0) * (n - 3.0)) END), 6) AS pass4 FROM v GROUP BY step),
n AS (SELECT batch_id AS step, round(avg(er) FILTER (termination = 'natural'), 6) AS natural_success, round(avg(CAST(usd > 0.06 AS INTEGER)), 6) AS unrequested_frac
  FROM scored WHERE trains GROUP BY batch_id)
SELECT * FROM p JOIN n USING (step)""")
def validation_row(spark, d):
    t = T.rollouts(spark, d).where(~E.needs_reroll(F.col("termination")))
    nat = F.col("termination") == "natural"
    v = t.groupBy(F.col("batch_id").alias("step"), "task_id").agg(
        F.sum(er()).alias("c"), F.count(F.lit(1)).alias("n"), F.count_if(nat).alias("nat"), F.count_if(F.col("usd") > 0.06).alias("unreq"))
    from tracemill.functions.stats import subset_ratio
    c, n = F.col("c"), F.col("n")
    return v.groupBy("step").agg(
        F.count(F.lit(1)).alias("tasks"), F.sum("n").alias("episodes"), r6(F.avg(subset_ratio(c, n, 1))).alias("pass1"),
        r6(F.avg(subset_ratio(c, n, 2))).alias("pass2"), r6(F.avg(subset_ratio(c, n, 4))).alias("pass4"), r6(F.try_divide(F.sum("c"), F.sum("nat"))).alias("natural_success"),
        r6(F.sum("unreq") / F.sum("n")).alias("unrequested_frac"))


@query("customer_vet", R + """,
s AS (SELECT CASE WHEN batch_id < 30 THEN 'reference' WHEN batch_id < 60 THEN 'first' WHEN batch_id < 80 THEN 'second' ELSE 'third' END AS arm, termination, usd, n_turns, reward FROM rollouts
  WHERE termination <> 'customer_api_error'),
a AS (SELECT arm, count(*) AS n, avg(CASE WHEN termination = 'natural' THEN reward ELSE 0 END) AS success, count(*) FILTER (termination = 'max_turns') AS loops,
  avg(usd) AS cost, median(n_turns) AS median_turns FROM s GROUP BY arm),
r AS (SELECT success AS ref FROM a WHERE arm = 'reference'),
w AS (SELECT arm, n, success, loops, cost, median_turns, CASE WHEN n < 24 THEN 'no result' WHEN loops * 1.0 / n > 0.0905 THEN 'loops' WHEN success < ref - 0.10 THEN 'success'
  WHEN cost > 0.05 THEN 'cost' ELSE 'pass' END AS verdict FROM a, r)
SELECT arm, n, round(success, 6) AS success, loops, round(cost, 6) AS cost, round(median_turns, 6) AS median_turns, verdict,
  arm = (SELECT min_by(arm, CASE arm WHEN 'third' THEN 1 WHEN 'second' THEN 2 ELSE 3 END) FROM w WHERE verdict = 'pass' AND arm <> 'reference') AS chosen FROM w""")
def customer_vet(spark, d):
    """Candidate simulators against a reference arm: the first rule that fails names the verdict, and the
    first passing arm in preference order is chosen."""
    b = F.col("batch_id")
    arm = F.when(b < 30, "reference").when(b < 60, "first").when(b < 80, "second").otherwise("third")
    a = T.rollouts(spark, d).where(~E.needs_reroll(F.col("termination"))).groupBy(arm.alias("arm")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(er()).alias("success"), F.count_if(F.col("termination") == "max_turns").alias("loops"),
        F.avg("usd").alias("cost"), F.median("n_turns").alias("median_turns"))
    ref = a.where("arm = 'reference'").agg(F.max("success")).scalar()
    v = a.withColumn("verdict", F.when(F.col("n") < 24, "no result").when(F.col("loops") / F.col("n") > 0.0905, "loops")
                     .when(F.col("success") < ref - 0.10, "success").when(F.col("cost") > 0.05, "cost").otherwise("pass"))
    pref = F.when(F.col("arm") == "third", 1).when(F.col("arm") == "second", 2).otherwise(3)
    best = v.where("verdict = 'pass' and arm <> 'reference'").agg(F.min_by("arm", pref)).scalar()
    return v.select("arm", "n", r6(F.col("success")).alias("success"), "loops", r6(F.col("cost")).alias("cost"),
                    r6(F.col("median_turns")).alias("median_turns"), "verdict", (F.col("arm") == best).alias("chosen"))
