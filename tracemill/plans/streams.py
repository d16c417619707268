"""Monitoring streams drained over the given tables; the SQL states the final state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import episode as E
from tracemill.operators import endings as N
from tracemill.operators import skew
from tracemill.plans import conversations as CV
from tracemill.plans.registry import query, r6
from tracemill.session import materialise
from tracemill.sources import tables as T
from tracemill.streaming import monitors as M
from tracemill.streaming import sinks as S


def _stream(spark, d, name):
    # a pattern, so that the table may be one file or a folder of files
    return S.table_stream(spark, f"{d}/{name}.parquet*", spark.read.parquet(f"{d}/{name}.parquet").schema)


def _rollout_stream(spark, d):
    """The rollouts view over the lineitem stream."""
    li = _stream(spark, d, "lineitem")
    disc = F.col("l_discount")
    return li.select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("task_id"), F.col("l_suppkey").alias("batch_id"),
                     F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("reward"),
                     F.when(disc < 0.005, "customer_api_error").when(disc < 0.015, "max_turns").when(disc < 0.025, "length").otherwise("natural").alias("termination"),
                     F.col("l_extendedprice").alias("neg_logprob"), F.col("l_quantity").alias("tokens"), F.col("l_tax").alias("usd"))


@query("stream_ledger_total", "SELECT event_type AS what, count(*) AS lines, round(sum(value), 4) AS spent, sum(value) >= 15000 AS stop FROM events GROUP BY event_type")
def stream_ledger_total(spark, d):
    ev = _stream(spark, d, "events").select(F.col("event_type").alias("what"), F.col("value").alias("usd"))
    out = S.latest(S.drain(M.ledger_totals(ev, ["what"], 15000), "update", "ledger"), ["what"])
    return out.select("what", "lines", F.round("spent", 4).alias("spent"), "stop")


@query("stream_watchdog", """SELECT event_type AS run, count(*) AS episodes, round(sum(value) * 1.45 + count(*) * 0.5, 4) AS estimated,
  CASE WHEN sum(value) * 1.45 + count(*) * 0.5 > 16500 THEN 'ceiling' WHEN count(*) >= 100 AND avg(value) > 5.2 THEN 'per_episode' WHEN epoch_us(max(ts)) - epoch_us(min(ts)) > 3 * 3600 * 1000000 THEN 'hours' END AS alert FROM events GROUP BY event_type""")
def stream_watchdog(spark, d):
    ev = _stream(spark, d, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("id"), F.col("value").alias("usd"), F.col("ts").alias("at"))
    out = S.latest(S.drain(M.watchdog(ev, ["run"], 16500, per_episode=0.5, max_per_episode=5.2), "update", "watchdog"), ["run"])
    return out.select("run", "episodes", F.round("estimated", 4).alias("estimated"), "alert")


@query("stream_group_settlement", T.with_sql(T.ROLLOUTS_SQL) + """SELECT group_id, count(*) AS landed, CASE WHEN count(*) < 4 THEN 'partial' WHEN bool_or(termination = 'customer_api_error') THEN 'dropped' ELSE 'kept' END AS verdict
FROM rollouts GROUP BY group_id""")
def stream_group_settlement(spark, d):
    return S.latest(S.drain(M.settled_groups(_rollout_stream(spark, d), 4), "update", "settle"), ["group_id"]).select("group_id", "landed", "verdict")


@query("stream_batch_counters", T.with_sql(T.ROLLOUTS_SQL) + """SELECT batch_id, count(*) AS episodes, count(*) FILTER (termination <> 'customer_api_error') AS trainable, round(sum(wall_s) / sum(n_turns), 4) AS entropy_proxy, round(sum(usd), 4) AS usd
FROM rollouts GROUP BY batch_id""")
def stream_batch_counters(spark, d):
    out = S.latest(S.drain(M.batch_counters(_rollout_stream(spark, d), ["batch_id"]), "update", "counters"), ["batch_id"])
    return out.select("batch_id", "episodes", "trainable", F.round("entropy_proxy", 4).alias("entropy_proxy"), F.round("usd", 4).alias("usd"))


@query("stream_posterior", T.with_sql(T.ROLLOUTS_SQL) + """, s AS (SELECT task_id, sum(CASE WHEN termination = 'natural' THEN reward ELSE 0 END) AS wins, count(*) AS obs FROM rollouts WHERE termination <> 'customer_api_error' GROUP BY task_id)
SELECT task_id, wins, obs, round(0.8 + wins, 6) AS a, round(0.3 + obs - wins, 6) AS b, obs >= 20 AND (0.8 + wins) / (1.1 + obs) > 0.4 AS retired FROM s""")
def stream_posterior(spark, d):
    out = S.latest(S.drain(M.posterior_stream(_rollout_stream(spark, d), 0.8, 0.3, 20, 0.4), "update", "posterior"), ["task_id"])
    return out.select("task_id", "wins", "obs", r6(F.col("a")).alias("a"), r6(F.col("b")).alias("b"), "retired")


@query("stream_consecutive_closings", f"""WITH u AS (SELECT conv_id, turn, {CV.CLOSING_SQL} AS c, lag({CV.CLOSING_SQL}) OVER (PARTITION BY conv_id ORDER BY turn) AS p
  FROM conversations WHERE role <> 'assistant') SELECT conv_id, min(turn) AS turn FROM u WHERE c AND p GROUP BY conv_id""")
def stream_consecutive_closings(spark, d):
    u = _stream(spark, d, "conversations").where("role <> 'assistant'")
    return S.drain(M.closing_stream(u, "conv_id", "turn", CV.closing()), "append", "closings").select("conv_id", "turn")


@query("stream_terminations", """WITH s AS (SELECT user_id, ts, event_id, row_number() OVER w AS steps, sum(CAST(event_type = 'error' AS INTEGER)) OVER w AS errors,
  event_type = 'signup' AND value > 25 AS nat FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, CASE WHEN nat THEN 'natural' WHEN steps >= 40 THEN 'max_turns' WHEN errors >= 5 THEN 'too_many_errors' END AS cause FROM s)
SELECT user_id, min_by(cause, steps) AS termination, min(steps) AS steps FROM c WHERE cause IS NOT NULL GROUP BY user_id""")
def stream_terminations(spark, d):
    ev = _stream(spark, d, "events")
    out = M.ending_stream(ev, "user_id", ["ts", "event_id"], F.col("event_type") == "error", (F.col("event_type") == "signup") & (F.col("value") > 25), 40, 5)
    return S.drain(out, "append", "endings").select("user_id", "termination", "steps")


@query("stream_metrics_append", "SELECT DISTINCT l_suppkey AS step, l_linenumber AS repeat FROM lineitem")
def stream_metrics_append(spark, d):
    """Log rows arriving more than once, in three batches with a restart before each, are written once."""
    rows = T.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("step"), F.col("l_linenumber").alias("repeat"), (F.col("l_partkey") % 3).alias("b"))
    slices = [rows.where(F.col("b") == b) for b in range(3)]
    out = S.replayed(slices, lambda s: s.select("step", "repeat"), "append", "metrics", lambda path: S.append_new_rows(path, ["step", "repeat"], F.floor(F.col("step") / 16)))
    return out.select("step", "repeat")


# ------------------------------------------------------------------ several batches with a restart before each

LIMITS = N.Limits(55, 9, 2, 1)
MOVES_SQL = """WITH m AS (SELECT user_id, event_id, event_type AS t, value AS v, event_id * 7919 % 1000 AS h, row_number() OVER w - 1 AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, t IN ('purchase', 'signup') AS reply, t IN ('purchase', 'signup') AND v < 8 AS closing, t = 'signup' AND v > 45 AS done, t = 'signup' AND v > 45 AND event_id % 3 < 2 AS soft,
  CASE WHEN t IN ('view', 'click') AND h < 2 THEN 'length' WHEN t IN ('view', 'click') AND h < 5 THEN 'tool_parse_error' WHEN t IN ('view', 'click') AND h < 8 THEN 'empty_message'
    WHEN t = 'error' AND h < 4 THEN 'no_progress_timeout' WHEN t = 'error' AND h < 8 THEN 'env_exception' WHEN t = 'purchase' AND h < 6 THEN 'customer_api_error' END AS cause,
  CASE WHEN t = 'error' AND v > 20 THEN 1 ELSE 0 END AS errs FROM m),
f AS (SELECT *, sum(errs) OVER w AS errors, count(*) FILTER (soft) OVER w AS softs, last_value(CASE WHEN reply THEN closing END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed
  FROM c WINDOW w AS (PARTITION BY user_id ORDER BY i)),
e AS (SELECT user_id, i, coalesce(cause, CASE WHEN done AND NOT (soft AND softs <= 2) OR closing AND coalesce(closed, false) THEN 'natural' WHEN t = 'view' THEN NULL WHEN i + 2 >= 55 THEN 'max_turns' WHEN errors >= 9 THEN 'too_many_errors' END) AS cause FROM f),
ends AS (SELECT user_id, min_by(cause, i) FILTER (cause IS NOT NULL) AS termination, min(i) FILTER (cause IS NOT NULL) AS i, count(*) AS n FROM e GROUP BY user_id),
done AS (SELECT user_id, coalesce(termination, 'open') AS termination,
  CASE WHEN termination IS NULL THEN n + 1 WHEN termination IN ('no_progress_timeout', 'env_exception', 'customer_api_error') THEN i + 1 ELSE i + 2 END AS steps FROM ends)
"""


def _numbered_events(spark, d):
    ev = T.table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return skew.position(ev, ["user_id"], [F.col("ts"), F.col("event_id")], skew.evenly(ev, "ts"), "n").withColumn("i", F.col("n") - 1)


def _moves(ev, at=None):
    """Events as moves: views are agent turns with calls, clicks without, errors are tool results, the rest are customer replies."""
    t, v, h = F.col("event_type"), F.col("value"), F.col("event_id") * 7919 % 1000
    agent, bad = t.isin("view", "click"), t == "error"
    causes = {"length": agent & (h < 2), "tool_parse_error": agent & (h < 5), "empty_message": agent & (h < 8), "no_progress_timeout": bad & (h < 4),
              "env_exception": bad & (h < 8), "customer_api_error": (t == "purchase") & (h < 6)}
    role = F.when(agent, "agent").when(bad, "tool").otherwise("customer")
    return N.moves(ev, "user_id", "i", role, causes, t == "view", (v > 20).cast("int"), v < 8, (t == "signup") & (v > 45), F.col("event_id") % 3 < 2, at)


@query("episode_endings", MOVES_SQL + "SELECT user_id, termination, steps FROM done")
def episode_endings(spark, d):
    """All endings of an episode by its composed segments, in runs of 16 moves."""
    return N.endings(_moves(_numbered_events(spark, d)), "user_id", LIMITS, 16)


@query("stream_endings", MOVES_SQL + "SELECT user_id, termination, steps FROM done WHERE termination <> 'open'")
def stream_endings(spark, d):
    """The same as moves arrive in any order: four batches by a hash of the event."""
    ev = materialise(_numbered_events(spark, d), "numbered")
    slices = [ev.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == b) for b in range(4)]
    out = S.replayed(slices, lambda s: M.endings_stream(_moves(s, "ts"), "user_id", LIMITS, "3650 days", 60), "append", "endings")
    return out.select("user_id", "termination", "steps")


@query("stream_stale_runs", """WITH e AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt, max(ts) OVER () AS final FROM events)
SELECT user_id, ts AS last_at FROM e WHERE epoch_us(coalesce(nxt, final)) - epoch_us(ts) > 129600000000""")
def stream_stale_runs(spark, d):
    """Users without an event for a day and a half, by event time; the events come in four batches in order of time."""
    ev = T.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    day = F.floor(F.unix_micros("ts") / 86_400_000_000)
    first = ev.agg(F.min(day)).scalar()
    slices = [ev.where(F.least(F.lit(3), F.floor((day - first) / 8)) == b) for b in range(4)]
    out = S.replayed(slices, lambda s: M.stale_gaps(s, "user_id", "ts", 36 * 60, "0 seconds"), "append", "stale")
    return out.select("user_id", "last_at")


ROLLOUT_GROUPS_SQL = """WITH s AS (SELECT l_orderkey, l_quantity AS q, l_tax, l_discount, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax) - 1 AS n FROM lineitem),
g AS (SELECT l_orderkey * 8 + n // 4 AS group_id, n % 4 AS slot, l_discount < 0.005 AS failed, q, l_tax FROM s),
r AS (SELECT group_id, slot, failed, (group_id % 60) * 24 + CAST(slot * q AS BIGINT) + CASE WHEN slot = 3 AND l_tax >= 0.07 THEN 480 ELSE 0 END AS hour FROM g),
"""


def _timed_rollouts(spark, d):
    """Rollouts in groups of four with the time they land; some come three weeks late."""
    li = T.table(spark, d, "lineitem")
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")]
    n = skew.position(li.select("l_orderkey", *order), ["l_orderkey"], order, skew.evenly(li, "l_shipdate"), "n").withColumn("n", F.col("n") - 1)
    g = n.select((F.col("l_orderkey") * 8 + F.expr("n div 4")).alias("group_id"), (F.col("n") % 4).cast("int").alias("slot"), (F.col("l_discount") < 0.005).alias("failed"), "l_quantity", "l_tax")
    hour = F.col("group_id") % 60 * 24 + (F.col("slot") * F.col("l_quantity")).cast("bigint") + F.when((F.col("slot") == 3) & (F.col("l_tax") >= 0.07), 480).otherwise(0)
    return g.select("group_id", "slot", "failed", hour.alias("hour"), (F.lit(1_704_067_200) + hour * 3600).cast("timestamp").alias("at"))


@query("stream_settled_once", ROLLOUT_GROUPS_SQL + """o AS (SELECT *, row_number() OVER w AS k, hour - lag(hour) OVER w > 240 AS broke, max(hour) OVER () AS final FROM r WINDOW w AS (PARTITION BY group_id ORDER BY hour, slot)),
b AS (SELECT *, count(*) FILTER (broke) OVER (PARTITION BY group_id ORDER BY k) AS breaks FROM o),
u AS (SELECT group_id, count(*) FILTER (breaks = 0) AS landed, bool_or(failed) FILTER (breaks = 0) AS failed, max(breaks) > 0 OR max(hour) + 240 < any_value(final) AS flushed FROM b GROUP BY group_id)
SELECT group_id, landed, CASE WHEN landed < 4 THEN 'partial' WHEN failed THEN 'dropped' ELSE 'kept' END AS verdict FROM u WHERE landed = 4 OR flushed""")
def stream_settled_once(spark, d):
    """Every group settled once: kept or dropped with its fourth rollout, partial after ten days without one."""
    r = materialise(_timed_rollouts(spark, d), "rollouts")
    slices = [r.where(F.least(F.lit(3), F.floor(F.col("hour") / 540)) == b) for b in range(4)]
    out = S.replayed(slices, lambda s: M.settled_once(s, "group_id", "slot", "at", F.col("failed"), 4, 14_400, 57_600, "0 seconds"), "append", "settled")
    return out.select("group_id", "landed", "verdict")


def _by_year(spark, d):
    """Lines by the year they ship, seven years from the first; a year is a step."""
    li = T.table(spark, d, "lineitem")
    first = li.agg(F.min(F.year("l_shipdate"))).scalar()
    return [li.where(F.least(F.lit(6), F.year("l_shipdate") - first) == b) for b in range(7)]


STEP_SQL = "WITH RECURSIVE li AS (SELECT *, least(6, year(l_shipdate) - (SELECT min(year(l_shipdate)) FROM lineitem)) AS step FROM lineitem),\n"


@query("stream_failure_ema", STEP_SQL + """f AS (SELECT step, CASE WHEN l_tax > 0.06 THEN 'wrong_target' WHEN l_quantity < 10 THEN 'missed_write' ELSE 'wrong_args' END AS class FROM li WHERE l_returnflag = 'A'),
s AS (SELECT step, class, n * 1.0 / sum(n) OVER (PARTITION BY step) AS share FROM (SELECT step, class, count(*) AS n FROM f GROUP BY ALL)), k AS (SELECT step, row_number() OVER (ORDER BY step DESC) AS back FROM (SELECT DISTINCT step FROM f))
SELECT class, round(sum(share * power(0.5, back)), 6) AS ema FROM s JOIN k USING (step) GROUP BY class""")
def stream_failure_ema(spark, d):
    """The exponential mean of each failure class's share, a step a batch."""
    cls = F.when(F.col("l_tax") > 0.06, "wrong_target").when(F.col("l_quantity") < 10, "missed_write").otherwise("wrong_args")
    out = S.replayed(_by_year(spark, d), lambda s: s.where("l_returnflag = 'A'").select(cls.alias("class")), "append", "ema", M.ema_sink)
    last = out.agg(F.max("epoch")).scalar()
    return out.where(F.col("epoch") == last).select("class", r6(F.col("ema")).alias("ema"))


@query("stream_family_levels", STEP_SQL + """e AS (SELECT step, 'f' || l_linenumber AS family, l_partkey % 3 + 1 AS level, CASE WHEN l_discount < 0.01 * (4 + l_linenumber) THEN 1 ELSE 0 END AS reward FROM li),
per AS (SELECT step, family, level, count(*) AS n, sum(reward) AS wins FROM e GROUP BY ALL),
lv AS (SELECT DISTINCT family, CAST(-1 AS BIGINT) AS step, CAST(1 AS BIGINT) AS level FROM per
  UNION ALL SELECT lv.family, lv.step + 1, lv.level + CASE WHEN n >= 16 AND CAST(wins AS DOUBLE) / n >= CAST(0.85 AS DOUBLE) AND lv.level < 3 THEN 1 ELSE 0 END
  FROM lv LEFT JOIN per ON per.family = lv.family AND per.step = lv.step + 1 AND per.level = lv.level WHERE lv.step < 6)
SELECT family, CAST(level AS INTEGER) AS level FROM lv WHERE step = 6""")
def stream_family_levels(spark, d):
    """The level of each family after a batch a year: one promotion a batch at most."""
    def episodes(s):
        return M.family_levels(s.select(F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("family"), (F.col("l_partkey") % 3 + 1).cast("int").alias("level"),
                                        F.when(F.col("l_discount") < 0.01 * (4 + F.col("l_linenumber")), 1).otherwise(0).alias("reward")))
    return S.latest(S.replayed(_by_year(spark, d), episodes, "update", "levels"), ["family"]).select("family", "level")
