"""Profile, prior and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import stats as S
from tracemill.functions import text as X
from tracemill.operators import evalstats as V
from tracemill.operators import profiles as P
from tracemill.plans.evaluation import ratio_sql
from tracemill.plans.registry import query, r6
from tracemill.sources import tables as T


def uniform_sql(seed, purpose: str, key: str) -> str:
    return f"(CAST('0x' || substr(md5('{seed}:{purpose}:' || CAST({key} AS VARCHAR)), 1, 8) AS UBIGINT) / 4294967296.0)"


def beta_sql(a: str, b: str, k: int) -> str:
    return "(" + " * ".join(f"(({a} + {i}) / ({a} + {b} + {i}))" for i in range(k)) + ")"


# Two profiles made at different times cover all live trials between them. A task is one of four variants of a part, so some
# tasks are known to one profile only and some to none.
EARLY, LATE = "month < TIMESTAMP '1998-07-01'", "month >= TIMESTAMP '1998-07-01'"
VARIANTS = 4
VARIANT_SQL = f"task_id * {VARIANTS} + order_id % {VARIANTS}"
TASKS_SQL = f"tasks AS (SELECT p_partkey * {VARIANTS} + v AS task_id, p_type, p_size FROM part, range({VARIANTS}) r(v))"


def variant_tasks(spark, d):
    """(task_id, p_type, p_size): the variants of every part."""
    variant = F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("v")
    return T.table(spark, d, "part").select("p_partkey", "p_type", "p_size", variant).select((F.col("p_partkey") * VARIANTS + F.col("v")).alias("task_id"), "p_type", "p_size")


def profile(spark, d, which: str, variants: bool = True):
    t = T.trials(spark, d).where(f"not dead and {which}")
    if variants:
        t = t.withColumn("task_id", F.col("task_id") * VARIANTS + F.col("order_id") % VARIANTS)
    return V.task_counts(t, []).select("task_id", F.col("c").alias("successes"), F.col("n").alias("trials"))


def base(spark, d):
    return profile(spark, d, "arm = 'base'", variants=False)


def _profile_sql(which: str, task: str = VARIANT_SQL) -> str:
    return f"(SELECT {task} AS task_id, sum(success) AS successes, count(*) AS trials FROM trials WHERE NOT dead AND {which} GROUP BY {task})"


PROFILE_SQL = T.TRIALS_SQL + f""",
old AS {_profile_sql("arm = 'base'", "task_id")},
early AS {_profile_sql(EARLY)}, late AS {_profile_sql(LATE)}, first AS {_profile_sql("arm = 'base'")}, second AS {_profile_sql("arm = 'trained'")}, known AS {_profile_sql("true")}, {TASKS_SQL}"""


@query("task_profile", T.with_sql(T.ROLLOUTS_SQL) + """SELECT task_id, sum(CASE WHEN termination = 'natural' THEN reward ELSE 0 END) AS successes,
  count(*) AS trials FROM rollouts WHERE termination <> 'customer_api_error' GROUP BY task_id""")
def task_profile(spark, d):
    return P.task_profile(T.rollouts(spark, d))


@query("profile_merge_add", "WITH " + PROFILE_SQL + """
SELECT 'all' AS mode, task_id, sum(successes) AS successes, sum(trials) AS trials FROM (SELECT * FROM early UNION ALL SELECT * FROM late) GROUP BY task_id
UNION ALL SELECT 'known_only' AS mode, task_id, sum(successes), sum(trials) FROM
  (SELECT * FROM early UNION ALL SELECT * FROM late SEMI JOIN early USING (task_id)) GROUP BY task_id""")
def profile_merge_add(spark, d):
    old, new = profile(spark, d, EARLY), profile(spark, d, LATE)
    return P.merge_add(old, new).withColumn("mode", F.lit("all")).unionByName(
        P.merge_add(old, new, known_only=True).withColumn("mode", F.lit("known_only")))


@query("profile_merge_overwrite", "WITH " + PROFILE_SQL + """
SELECT task_id, CASE WHEN n.task_id IS NOT NULL THEN n.successes ELSE o.successes END AS successes,
  CASE WHEN n.task_id IS NOT NULL THEN n.trials ELSE o.trials END AS trials FROM early o FULL JOIN late n USING (task_id)""")
def profile_merge_overwrite(spark, d):
    return P.merge_overwrite(profile(spark, d, EARLY), profile(spark, d, LATE))


@query("prior_inheritance", "WITH " + PROFILE_SQL + """,
pool AS (SELECT task_id, CASE WHEN p_type = 'PROMO' THEN p_size END AS base_id FROM tasks)
SELECT pool.task_id, CASE WHEN b.task_id IS NOT NULL THEN 'base' WHEN o.task_id IS NOT NULL THEN 'own' ELSE 'to_profile' END AS origin,
  CASE WHEN b.task_id IS NOT NULL THEN b.successes ELSE o.successes END AS successes,
  CASE WHEN b.task_id IS NOT NULL THEN b.trials ELSE o.trials END AS trials
FROM pool LEFT JOIN early o ON o.task_id = pool.task_id LEFT JOIN early b ON b.task_id = pool.base_id""")
def prior_inheritance(spark, d):
    pool = variant_tasks(spark, d).select("task_id", F.when(F.col("p_type") == "PROMO", F.col("p_size").cast("bigint")).alias("base_id"))
    return P.inherit(pool, profile(spark, d, EARLY))


@query("recent_else_full_prior", "WITH " + PROFILE_SQL + """,
j AS (SELECT t.task_id, n.successes AS rs, n.trials AS rt, o.successes AS fs, o.trials AS ft
  FROM tasks t LEFT JOIN second n ON n.task_id = t.task_id LEFT JOIN first o ON o.task_id = t.task_id),
k AS (SELECT task_id, coalesce(rt >= 4, false) AS use_recent, CASE WHEN rt >= 4 THEN rs ELSE fs END AS successes,
  CASE WHEN rt >= 4 THEN rt ELSE ft END AS trials FROM j)
SELECT task_id, coalesce(successes > 0 AND successes < trials, false) AS keep,
  CASE WHEN use_recent AND successes > 0 AND successes < trials THEN 'recent mixed' WHEN use_recent AND successes > 0 THEN 'recent always'
       WHEN use_recent THEN 'recent never' WHEN successes > 0 AND successes < trials THEN 'full mixed (recent thin)'
       ELSE 'full not mixed (recent thin)' END AS why, successes, trials FROM k""")
def recent_else_full_prior(spark, d):
    return P.recent_else_full(variant_tasks(spark, d).select("task_id"), profile(spark, d, "arm = 'trained'"), profile(spark, d, "arm = 'base'"))


@query("needs_profiling", "WITH " + PROFILE_SQL + """
SELECT task_id, CASE WHEN trials IS NULL THEN 'never tried' ELSE 'thin and all-success' END AS reason
FROM tasks LEFT JOIN known USING (task_id) WHERE trials IS NULL OR (trials < 4 AND successes = trials)""")
def needs_profiling(spark, d):
    return P.needs_profiling(variant_tasks(spark, d).select("task_id"), profile(spark, d, "true"))


SHORT_SQL = f""",
short_old AS (SELECT {VARIANT_SQL} AS task_id, sum(success) AS successes, count(*) AS trials FROM trials WHERE arm = 'base' GROUP BY {VARIANT_SQL}),
short_new AS (SELECT {VARIANT_SQL} AS task_id, sum(success) AS successes, count(*) AS trials FROM trials WHERE arm = 'trained' GROUP BY {VARIANT_SQL}),
{TASKS_SQL},
pooled AS (SELECT t.task_id, p_type AS family, greatest(coalesce(o.successes, 0), coalesce(n.successes, 0)) AS successes,
  greatest(coalesce(o.trials, 0), coalesce(n.trials, 0)) AS trials
  FROM tasks t LEFT JOIN short_old o ON o.task_id = t.task_id LEFT JOIN short_new n ON n.task_id = t.task_id)"""


def _short(spark, d, arm):
    t = T.trials(spark, d).where(F.col("arm") == arm).withColumn("task_id", F.col("task_id") * VARIANTS + F.col("order_id") % VARIANTS)
    return V.task_counts(t, []).select("task_id", F.col("c").alias("successes"), F.col("n").alias("trials"))


def _pooled(spark, d):
    tasks = variant_tasks(spark, d).select("task_id", F.col("p_type").alias("family"))
    return P.pool_by_max(tasks, _short(spark, d, "base"), _short(spark, d, "trained"))


@query("never_solved_by_family", "WITH " + T.TRIALS_SQL + SHORT_SQL + " UNION ALL ".join(
    f"SELECT family, {a} AS attempts, count(*) AS tasks FROM pooled WHERE successes = 0 AND trials >= {a} GROUP BY family " for a in (4, 8, 16)))
def never_solved_by_family(spark, d):
    return P.never_solved(_pooled(spark, d), ["family"], [4, 8, 16])


@query("teacher_by_difficulty", "WITH " + T.TRIALS_SQL + SHORT_SQL + """,
banded AS (SELECT task_id, CASE WHEN successes = 0 THEN '0' WHEN successes * 1.0 / trials < 0.25 THEN '(0,.25)'
  WHEN successes * 1.0 / trials < 0.5 THEN '[.25,.5)' ELSE '[.5,1]' END AS band FROM short_old)
SELECT band, count(*) AS tasks, round(avg(n.successes * 1.0 / n.trials), 6) AS teacher_pass1, count(*) FILTER (n.successes > 0) AS solved_once,
  count(*) FILTER (band = '0' AND n.successes = 0) AS unsolvable FROM banded JOIN short_new n USING (task_id) GROUP BY band""")
def teacher_by_difficulty(spark, d):
    """How a second model does on tasks grouped by how hard the first finds them."""
    p = F.col("successes") / F.col("trials")
    band = F.when(F.col("successes") == 0, "0").when(p < 0.25, "(0,.25)").when(p < 0.5, "[.25,.5)").otherwise("[.5,1]")
    own = _short(spark, d, "base").select("task_id", band.alias("band"))
    j = own.join(_short(spark, d, "trained"), "task_id")
    return j.groupBy("band").agg(F.count(F.lit(1)).alias("tasks"), r6(F.avg(p)).alias("teacher_pass1"),
                                 F.count_if(F.col("successes") > 0).alias("solved_once"),
                                 F.count_if((F.col("band") == "0") & (F.col("successes") == 0)).alias("unsolvable"))


@query("family_profile_report", "WITH " + PROFILE_SQL + """SELECT p_type AS family, count(*) AS n, round(avg(successes * 1.0 / trials), 6) AS mean_p,
  round(avg(CAST(successes = trials AS INTEGER)), 6) AS always, round(avg(CAST(successes = 0 AS INTEGER)), 6) AS never,
  round(avg(CAST(successes > 0 AND successes < trials AS INTEGER)), 6) AS mixed, round(sum(successes) * 1.0 / sum(trials), 6) AS rate
FROM old JOIN part ON p_partkey = task_id GROUP BY p_type""")
def family_profile_report(spark, d):
    fam = T.table(spark, d, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_type").alias("family"))
    j = base(spark, d).join(fam, "task_id")
    rep = P.family_report(j, "family").join(P.subset_rate(j, ["family"]).drop("tasks"), "family")
    return rep.select("family", "n", *[r6(F.col(c)).alias(c) for c in ("mean_p", "always", "never", "mixed", "rate")])


PRIOR_SQL = """,
m AS (SELECT count(*) AS rows_, avg(trials) AS n, avg(successes * 1.0 / trials) AS m, var_samp(successes * 1.0 / trials) AS v FROM old WHERE trials > 1),
rho AS (SELECT *, (v * n / (m * (1 - m)) - 1) / (n - 1) AS rho FROM m),
prior AS (SELECT CASE WHEN rows_ >= 10 AND m > 0 AND m < 1 AND rho > 0 AND rho < 1 THEN greatest(0.05, m * (1 / rho - 1)) ELSE 1.0 END AS a0,
  CASE WHEN rows_ >= 10 AND m > 0 AND m < 1 AND rho > 0 AND rho < 1 THEN greatest(0.05, (1 - m) * (1 / rho - 1)) ELSE 1.0 END AS b0 FROM rho)"""


@query("beta_prior", "WITH " + PROFILE_SQL + PRIOR_SQL + "SELECT round(a0, 4) AS a0, round(b0, 4) AS b0 FROM prior")
def beta_prior(spark, d):
    p = P.beta_prior(base(spark, d))
    return p.select(F.round("a0", 4).alias("a0"), F.round("b0", 4).alias("b0"))


POST_SQL = PRIOR_SQL + """,
post AS (SELECT task_id, successes, trials, a0, b0, a0 + successes AS a, b0 + trials - successes AS b FROM old, prior)"""


def _post(spark, d):
    p = base(spark, d)
    return P.posterior(p.select("task_id"), p)


@query("posterior_weights", "WITH " + PROFILE_SQL + POST_SQL + f"""SELECT task_id, successes > 0 AND successes < trials AS in_mixed_pool,
  successes < trials AS in_not_always_pool, round(a / (a + b), 6) AS mean,
  round(1 - {beta_sql('a', 'b', 8)} - {beta_sql('b', 'a', 8)}, 6) AS mixed_weight,
  round((1 - {beta_sql('a', 'b', 8)} - {beta_sql('b', 'a', 8)}) * 4 * {beta_sql('a', 'b', 3)} / 8, 6) AS pass4_weight,
  a + b - a0 - b0 >= 10 AND a / (a + b) > 0.5 AS retired FROM post""")
def posterior_weights(spark, d):
    p = P.retire(_post(spark, d), 10, 0.5)
    a, b = F.col("a"), F.col("b")
    return p.select("task_id", P.pool_rule("mixed").alias("in_mixed_pool"), P.pool_rule("not_always").alias("in_not_always_pool"),
                    r6(a / (a + b)).alias("mean"), r6(P.value_weight(a, b, 8)).alias("mixed_weight"),
                    r6(P.value_weight(a, b, 8, "pass4")).alias("pass4_weight"), "retired")


@query("weighted_task_draw", "WITH " + PROFILE_SQL + POST_SQL + f""",
w AS (SELECT task_id, 1 - {beta_sql('a', 'b', 8)} - {beta_sql('b', 'a', 8)} AS w FROM post WHERE successes > 0 AND successes < trials),
f AS (SELECT task_id, greatest(w, 0.02 * max(w) OVER ()) AS w FROM w)
SELECT task_id, round(w, 6) AS weight FROM f ORDER BY -ln(greatest({uniform_sql(11, 'race', 'task_id')}, pow(2.0, -33))) / w, task_id LIMIT 64""")
def weighted_task_draw(spark, d):
    p = _post(spark, d).where(P.pool_rule("mixed")).select("task_id", P.value_weight(F.col("a"), F.col("b"), 8).alias("w"))
    top = p.agg(F.max("w")).scalar()
    return P.draw_weighted(p, "w", 64, 11).select("task_id", r6(F.greatest(F.col("w"), F.lit(0.02) * top)).alias("weight"))


FAMILY_ID = """concat('tt_', CASE p_type WHEN 'PROMO' THEN 'items_addr' WHEN 'SMALL' THEN 'pairing' WHEN 'LARGE' THEN 'keep_options' ELSE 'decoy_first' END,
 '_L', CASE WHEN p_size <= 16 THEN 1 WHEN p_size <= 33 THEN 2 ELSE 3 END, '_', p_partkey)"""


def family_of(task_id):
    """(family, level) of a generated task id tt_<family>_L<level>_<n>; null family and level 0 otherwise."""
    shape = r"^tt_(.*)_L(\d+)_[^_]*$"
    return (F.nullif(F.regexp_extract(task_id, shape, 1), F.lit("")),
            F.coalesce(F.nullif(F.regexp_extract(task_id, shape, 2), F.lit("")).cast("int"), F.lit(0)))


def _families(spark, d):
    ids = T.table(spark, d, "part").select(F.col("p_partkey").alias("task_id"), F.expr(FAMILY_ID).alias("name"))
    fam, level = family_of(F.col("name"))
    return ids.select("task_id", "name", fam.alias("family"), level.alias("level"))


@query("family_and_level", f"""SELECT regexp_extract(name, '^tt_(.*)_L([0-9]+)_', 1) AS family,
  CAST(regexp_extract(name, '^tt_(.*)_L([0-9]+)_', 2) AS INTEGER) AS level, count(*) AS tasks FROM (SELECT {FAMILY_ID} AS name FROM part) GROUP BY ALL""")
def family_and_level(spark, d):
    return _families(spark, d).groupBy("family", "level").agg(F.count(F.lit(1)).alias("tasks"))


FAM_SQL = f""",
fam AS (SELECT p_partkey AS task_id, regexp_extract({FAMILY_ID}, '^tt_(.*)_L([0-9]+)_', 1) AS family,
  CAST(regexp_extract({FAMILY_ID}, '^tt_(.*)_L([0-9]+)_', 2) AS INTEGER) AS level FROM part)"""


@query("family_promotion", T.with_sql(T.ROLLOUTS_SQL) + FAM_SQL + """
SELECT family, 2 AS current, count(*) AS obs, round(avg(CASE WHEN termination = 'natural' THEN reward ELSE 0 END), 6) AS rate,
  CASE WHEN count(*) >= 16 AND avg(CASE WHEN termination = 'natural' THEN reward ELSE 0 END) >= 0.27 THEN 3 ELSE 2 END AS next
FROM rollouts JOIN fam USING (task_id) WHERE level = 2 AND termination <> 'customer_api_error' GROUP BY family""")
def family_promotion(spark, d):
    fam = _families(spark, d)
    eps = T.rollouts(spark, d).where("termination <> 'customer_api_error'").join(fam, "task_id").select(
        "family", "level", F.when(F.col("termination") == "natural", F.col("reward")).otherwise(0).alias("reward"))
    levels = fam.select("family").distinct().withColumn("current", F.lit(2))
    return P.promote(eps, levels, at=0.27).withColumn("rate", r6(F.col("rate")))


@query("failure_share_ema", T.with_sql(T.TRIALS_SQL) + """,
f AS (SELECT arm, datediff('month', TIMESTAMP '1990-01-01', month) AS step,
  CASE WHEN dead THEN 'runaway' WHEN usd < 0.03 THEN 'wrong_args' ELSE 'missed_write' END AS class, count(*) AS failures
  FROM trials WHERE success = 0 GROUP BY ALL),
t AS (SELECT arm, step, sum(failures) AS total, row_number() OVER (PARTITION BY arm ORDER BY step DESC) - 1 AS age FROM f GROUP BY arm, step)
SELECT arm, class, round(sum(0.5 * pow(0.5, age) * failures / total), 6) AS ema FROM f JOIN t USING (arm, step) GROUP BY arm, class""")
def failure_share_ema(spark, d):
    return _failure_shares(spark, d).withColumn("ema", r6(F.col("ema")))


def _failure_shares(spark, d):
    step = (F.year("month") - 1990) * 12 + F.month("month") - 1
    cls = F.when(F.col("dead"), "runaway").when(F.col("usd") < 0.03, "wrong_args").otherwise("missed_write")
    by = T.trials(spark, d).where("success = 0").groupBy("arm", step.alias("step"), cls.alias("class")).agg(F.count(F.lit(1)).alias("failures"))
    return P.failure_share_ema(by, ["arm"])


@query("family_weights", T.with_sql(T.TRIALS_SQL, T.ROLLOUTS_SQL) + FAM_SQL + """,
f AS (SELECT datediff('month', TIMESTAMP '1990-01-01', month) AS step, CASE WHEN dead THEN 'runaway' WHEN usd < 0.03 THEN 'wrong_args' ELSE 'missed_write' END AS class, count(*) AS failures
  FROM trials WHERE success = 0 AND arm = 'trained' GROUP BY ALL),
t AS (SELECT step, sum(failures) AS total, row_number() OVER (ORDER BY step DESC) - 1 AS age FROM f GROUP BY step),
shares AS (SELECT class, sum(0.5 * pow(0.5, age) * failures / total) AS ema FROM f JOIN t USING (step) GROUP BY class),
lv AS (SELECT family, CASE WHEN count(*) >= 16 AND avg(CASE WHEN termination = 'natural' THEN reward ELSE 0 END) >= 0.27 THEN 3 ELSE 2 END AS now
  FROM rollouts JOIN fam USING (task_id) WHERE level = 2 AND termination <> 'customer_api_error' GROUP BY family),
target AS (SELECT unnest(['items_addr', 'decoy_first', 'keep_options', 'pairing']) AS family, unnest(['missed_write', 'wrong_target', 'wrong_args', 'wrong_args']) AS class)
SELECT task_id, family, level, level <= coalesce(now, 2) AS eligible, round(CASE WHEN level = coalesce(now, 2) THEN 1.0 ELSE 0.5 END * (1 + 3.0 * coalesce(ema, 0)), 6) AS multiplier
FROM fam LEFT JOIN lv USING (family) LEFT JOIN target USING (family) LEFT JOIN shares USING (class)""")
def family_weights(spark, d):
    """Weight of a generated task: its family's level after promotion and the smoothed share of the failure class that the family
    is made against. Tasks above the level are not eligible yet. Families, levels and shares are a handful of rows."""
    fam, trained = _families(spark, d), F.col("arm") == "trained"
    shares = _failure_shares(spark, d).where(trained).select(F.col("class").alias("target"), F.col("ema").alias("share"))
    targets = F.create_map(*[F.lit(x) for kv in P.FAMILY_TARGETS.items() for x in kv])
    now = family_promotion(spark, d).select("family", "next").withColumn("target", F.try_element_at(targets, F.col("family")))
    known = fam.join(F.broadcast(now.join(shares, "target", "left")), "family", "left").withColumn("now", F.coalesce("next", F.lit(2)))
    return known.select("task_id", "family", "level", (F.col("level") <= F.col("now")).alias("eligible"),
                        r6(P.family_multiplier(F.col("family"), F.col("level"), F.col("now"), F.col("share"))).alias("multiplier"))


@query("variant_counts", """SELECT 't' || l_partkey AS base, count(DISTINCT l_linenumber) AS variants, count(*) AS groups FROM lineitem GROUP BY l_partkey""")
def variant_counts(spark, d):
    """Variants and groups of each base task, read from group ids b<batch>-<order>-t<part>_r<line>."""
    li = T.table(spark, d, "lineitem")
    name = F.concat(F.lit("b"), "l_suppkey", F.lit("-"), "l_orderkey", F.lit("-t"), "l_partkey", F.lit("_r"), "l_linenumber")
    task = P.task_of_group(name)
    # variants first: the distinct count then combines before the shuffle
    per = li.select(task.alias("task")).groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(P.base_of(F.col("task")).alias("base")).agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("groups"))


@query("dev_slice", "WITH " + PROFILE_SQL + """SELECT task_id, round(abs(successes * 1.0 / trials - 0.5), 6) AS distance FROM old
WHERE trials >= 6 AND round_even(8.0 * successes / trials, 0) BETWEEN 2 AND 6 ORDER BY abs(successes * 1.0 / trials - 0.5), CAST(task_id AS VARCHAR) LIMIT 16""")
def dev_slice(spark, d):
    p = F.col("successes") / F.col("trials")
    dist = F.abs(p - 0.5)
    return base(spark, d).where((F.col("trials") >= 6) & F.bround(8 * p, 0).between(2, 6)).orderBy(
        dist, F.col("task_id").cast("string")).limit(16).select("task_id", r6(dist).alias("distance"))
