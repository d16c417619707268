"""Call and message queries over the event stream and the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import calls as C
from tracemill.functions import text as X
from tracemill.operators import calls as K
from tracemill.operators import skew
from tracemill.plans.registry import query, r6
from tracemill.sources import tables as T

EV = T.with_sql(T.EVENT_CALLS_SQL)
CLOSING, REQUEST, PREMATURE, ENDING = "the|le|der|el|que|und", "zz|qq|is|and", "the|le|de", "is|et"
GOLD_SQL = """,
gold AS (SELECT user_id, tool, target FROM event_calls WHERE tool = 'purchase' AND NOT rejected AND value > 15),
done AS (SELECT episode_id, user_id, tool, target FROM event_calls WHERE tool NOT IN ('view', 'signup') AND NOT rejected),
dk AS (SELECT episode_id, user_id, tool, target, count(*) AS d FROM done GROUP BY ALL),
gk AS (SELECT user_id, tool, target, count(*) AS g FROM gold GROUP BY ALL),
tot AS (SELECT user_id, sum(g) AS total, count(*) AS gkeys FROM gk GROUP BY user_id),
m AS (SELECT episode_id, user_id, coalesce(sum(least(d, g)) FILTER (g IS NOT NULL), 0) AS matched, sum(d) AS done, sum(greatest(d - coalesce(g, 0), 0)) AS unrequested,
  bool_or(g IS NULL) AS off_target, count(g) AS keys_done FROM dk LEFT JOIN gk USING (user_id, tool, target) GROUP BY ALL),
mm AS (SELECT episode_id, user_id, matched, coalesce(total, 0) AS total, done - matched AS wrong, unrequested, off_target, keys_done < coalesce(gkeys, 0) AS missing
  FROM m LEFT JOIN tot USING (user_id))"""


def _write():
    return C.is_write(F.col("tool"), T.EVENT_READ)


def _gold_done(spark, d):
    c = T.event_calls(spark, d)
    gold = c.where((F.col("tool") == "purchase") & ~F.col("rejected") & (F.col("value") > 15))
    return gold, c.where(_write() & ~F.col("rejected"))


@query("tool_class_mix", EV + """SELECT CASE WHEN tool = 'signup' THEN 'auth' WHEN tool = 'view' THEN 'read' ELSE 'write' END AS class, tool,
  count(*) AS calls, count(*) FILTER (rejected) AS rejected FROM event_calls GROUP BY ALL""")
def tool_class_mix(spark, d):
    c = T.event_calls(spark, d)
    return c.groupBy(C.tool_class(F.col("tool"), T.EVENT_READ, T.EVENT_AUTH).alias("class"), "tool").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("rejected").alias("rejected"))


@query("auth_before_first_write", EV + """,
f AS (SELECT episode_id, min(struct_pack(ts := ts, e := event_id)) FILTER (tool = 'signup') AS a,
  min(struct_pack(ts := ts, e := event_id)) FILTER (tool NOT IN ('view', 'signup')) AS w FROM event_calls GROUP BY episode_id)
SELECT episode_id, CASE WHEN w IS NOT NULL THEN coalesce(a < w, false) END AS auth_first FROM f""")
def auth_before_first_write(spark, d):
    return K.auth_before_first_write(T.event_calls(spark, d), ["episode_id"], ["ts", "event_id"], F.col("tool").isin(*T.EVENT_AUTH), _write())


@query("auth_rate_of_writers", EV + """,
f AS (SELECT episode_id, min(struct_pack(ts := ts, e := event_id)) FILTER (tool = 'signup') AS a,
  min(struct_pack(ts := ts, e := event_id)) FILTER (tool NOT IN ('view', 'signup')) AS w FROM event_calls GROUP BY episode_id)
SELECT count(*) FILTER (w IS NOT NULL) AS wrote, count(*) FILTER (a < w) AS authenticated, round(count(*) FILTER (a < w) * 1.0 / count(*) FILTER (w IS NOT NULL), 6) AS rate FROM f""")
def auth_rate_of_writers(spark, d):
    return auth_before_first_write(spark, d).agg(
        F.count("auth_first").alias("wrote"), F.count_if("auth_first").alias("authenticated"), r6(F.avg(F.col("auth_first").cast("int"))).alias("rate"))


@query("repeated_calls", EV + """SELECT episode_id, sum(n) AS calls, sum(n - 1) AS repeated FROM
  (SELECT episode_id, tool, props, count(*) AS n FROM event_calls GROUP BY ALL) GROUP BY episode_id""")
def repeated_calls(spark, d):
    return K.repeated_calls(T.event_calls(spark, d), ["episode_id"], ["tool", "props"])


@query("rejected_writes", EV + "SELECT episode_id, count(*) AS writes, count(*) FILTER (rejected) AS rejected FROM event_calls WHERE tool NOT IN ('view', 'signup') GROUP BY episode_id")
def rejected_writes(spark, d):
    return T.event_calls(spark, d).where(_write()).groupBy("episode_id").agg(F.count(F.lit(1)).alias("writes"), F.count_if("rejected").alias("rejected"))


@query("write_match", EV + GOLD_SQL + "SELECT * FROM mm")
def write_match(spark, d):
    gold, done = _gold_done(spark, d)
    return K.write_match(done, gold, "episode_id", "user_id", ["tool", "target"])


@query("failure_classes", EV + GOLD_SQL + """,
e AS (SELECT episode_id, max(value) > 60 AS ok, count(*) < 6 AS nat FROM event_calls GROUP BY episode_id)
SELECT CASE WHEN ok THEN 'none' WHEN NOT nat THEN 'runaway' WHEN off_target THEN 'wrong_target' WHEN missing THEN 'missed_write'
  WHEN wrong > 0 OR matched < total THEN 'wrong_args' ELSE 'other' END AS failure_class, count(*) AS episodes FROM mm JOIN e USING (episode_id) GROUP BY ALL""")
def failure_classes(spark, d):
    e = T.event_calls(spark, d).groupBy("episode_id").agg((F.max("value") > 60).alias("ok"), (F.count(F.lit(1)) < 6).alias("nat"))
    j = write_match(spark, d).join(e, "episode_id")
    return j.groupBy(F.coalesce(K.failure_class(j, F.col("ok"), F.col("nat")), F.lit("none")).alias("failure_class")).agg(F.count(F.lit(1)).alias("episodes"))


@query("no_write_tasks_that_wrote", EV + GOLD_SQL + """,
none AS (SELECT DISTINCT user_id FROM event_calls ANTI JOIN (SELECT user_id FROM gold WHERE target::INT > 60) USING (user_id)),
e AS (SELECT user_id, episode_id, max(value) <= 30 AS failed FROM event_calls SEMI JOIN none USING (user_id) GROUP BY ALL)
SELECT tool, count(*) AS calls, count(DISTINCT episode_id) AS episodes FROM event_calls SEMI JOIN (SELECT episode_id FROM e WHERE failed) USING (episode_id)
WHERE tool NOT IN ('view', 'signup') GROUP BY tool""")
def no_write_tasks_that_wrote(spark, d):
    """Tasks whose gold has no write: which writes did failed episodes make anyway."""
    c = T.event_calls(spark, d)
    gold, _ = _gold_done(spark, d)
    none = c.select("user_id").distinct().join(gold.where(F.col("target").cast("int") > 60).select("user_id"), "user_id", "left_anti")
    per = c.groupBy("user_id", "episode_id", "tool").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    failed = per.groupBy("user_id", "episode_id").agg((F.max("top") <= 30).alias("failed")).where("failed").join(none, "user_id", "left_semi")
    return per.where(_write()).join(failed.select("episode_id"), "episode_id", "left_semi").groupBy("tool").agg(
        F.sum("n").alias("calls"), F.count(F.lit(1)).alias("episodes"))


@query("termination_fold", """WITH s AS (SELECT user_id, ts, event_id, row_number() OVER w AS steps, sum(CAST(event_type = 'error' AS INTEGER)) OVER w AS errors,
  event_type = 'signup' AND value > 25 AS nat FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, CASE WHEN nat THEN 'natural' WHEN steps >= 40 THEN 'max_turns' WHEN errors >= 5 THEN 'too_many_errors' END AS cause FROM s)
SELECT user_id, coalesce(min_by(cause, steps) FILTER (cause IS NOT NULL), 'open') AS termination,
  coalesce(min(steps) FILTER (cause IS NOT NULL), count(*)) AS steps FROM c GROUP BY user_id""")
def termination_fold(spark, d):
    ev = T.table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return K.termination_fold(ev, "user_id", [F.col("ts"), F.col("event_id")], skew.evenly(ev, "ts"), (F.col("event_type") == "error").cast("int"),
                              (F.col("event_type") == "signup") & (F.col("value") > 25), 40, 5)


@query("estimated_spend", EV + """,
p AS (SELECT * FROM (VALUES ('purchase', 0.25, 2.0), ('click', 0.05, 0.4)) AS t(tool, pin, pout)),
c AS (SELECT episode_id, CASE WHEN pin IS NOT NULL THEN (CASE WHEN value > 2 THEN value * 100 ELSE 8000 END * pin + CASE WHEN value > 2 THEN CAST(target AS DOUBLE) ELSE 1000 END * pout) / 1e6
  ELSE value / 1000 END AS usd FROM event_calls LEFT JOIN p USING (tool)),
e AS (SELECT episode_id, sum(usd) AS usd FROM c GROUP BY episode_id)
SELECT count(*) AS episodes, round(sum(usd), 4) AS reported_usd, round(sum(usd) * 1.45 + count(*) * 0.01, 4) AS estimated_usd, round(avg(usd), 6) AS usd_per_episode FROM e""")
def estimated_spend(spark, d):
    """Message costs from the price list, then the run estimate: cost times the judge factor plus a fixed
    sum per episode. The price list is configuration, a handful of rows."""
    prices = spark.createDataFrame([("purchase", 0.25, 2.0), ("click", 0.05, 0.4)], "tool string, price_in double, price_out double")
    c = T.event_calls(spark, d).select("episode_id", "tool", F.when(F.col("value") > 2, F.col("value") * 100).alias("tin"),
                                       F.when(F.col("value") > 2, F.col("target").cast("double")).alias("tout"), (F.col("value") / 1000).alias("reported"))
    e = K.price(c, F.broadcast(prices), "tool", "tin", "tout", "reported").groupBy("episode_id").agg(F.sum("usd").alias("usd"))
    return e.agg(F.count(F.lit(1)).alias("episodes"), F.round(F.sum("usd"), 4).alias("reported_usd"),
                 F.round(F.sum("usd") * 1.45 + F.count(F.lit(1)) * 0.01, 4).alias("estimated_usd"), r6(F.avg("usd")).alias("usd_per_episode"))


# ------------------------------------------------------------------ conversations

def conv(spark, d):
    return T.table(spark, d, "conversations")


def _b(p):  # whole words for the SQL engine, whose \b knows ASCII letters only
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_])({p})([^\p{{L}}\p{{N}}_]|$)"


STRIP_SQL = r"regexp_replace(replace(text, '###STOP###', ''), '^\s+|\s+$', '', 'g')"
CLOSING_SQL = (f"(length({STRIP_SQL}) BETWEEN 1 AND 160 AND regexp_matches({STRIP_SQL}, '{_b(CLOSING)}') "
               rf"AND NOT (contains({STRIP_SQL}, '?') OR regexp_matches({STRIP_SQL}, '{_b(REQUEST)}')))")


def closing():
    return X.is_closing_only(F.col("text"), CLOSING, REQUEST)


@query("message_classes", f"""WITH m AS (SELECT *, CASE WHEN turn >= 3 THEN text || ' ###STOP###' ELSE text END AS stopped FROM conversations)
SELECT role, count(*) AS messages, count(*) FILTER ({CLOSING_SQL}) AS closing_only,
  count(*) FILTER (contains(stopped, '###STOP###') AND (contains({STRIP_SQL}, '?') OR regexp_matches({STRIP_SQL}, '{_b(PREMATURE)}')) AND NOT regexp_matches({STRIP_SQL}, '{_b(ENDING)}')) AS premature_stops FROM m GROUP BY role""")
def message_classes(spark, d):
    stopped = F.when(F.col("turn") >= 3, F.concat("text", F.lit(" ###STOP###"))).otherwise(F.col("text"))
    return conv(spark, d).groupBy("role").agg(F.count(F.lit(1)).alias("messages"), F.count_if(closing()).alias("closing_only"),
                                              F.count_if(X.premature_stop(stopped, PREMATURE, ENDING)).alias("premature_stops"))


@query("consecutive_closings", f"""WITH u AS (SELECT conv_id, turn, {CLOSING_SQL} AS c, lag({CLOSING_SQL}) OVER (PARTITION BY conv_id ORDER BY turn) AS p
  FROM conversations WHERE role <> 'assistant') SELECT conv_id, min(turn) AS turn FROM u WHERE c AND p GROUP BY conv_id""")
def consecutive_closings(spark, d):
    u = conv(spark, d).where("role <> 'assistant'")
    return K.closing_twice(u, "conv_id", ["turn"], skew.evenly(u, "turn"), closing())


@query("opening_message", "SELECT conv_id, length(min_by(text, turn)) AS opening_chars, md5(min_by(text, turn)) AS opening_md5 FROM conversations WHERE role = 'user' GROUP BY conv_id")
def opening_message(spark, d):
    o = K.opening(conv(spark, d), "conv_id", "turn", F.col("role") == "user", "text")
    return o.select("conv_id", F.char_length("opening").alias("opening_chars"), F.md5("opening").alias("opening_md5"))


@query("opening_length_by_style", """WITH o AS (SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS op, bool_or(role = 'system') AS scripted FROM conversations GROUP BY conv_id)
SELECT scripted, count(*) AS conversations, round(median(length(op)), 6) AS median_opening FROM o GROUP BY scripted""")
def opening_length_by_style(spark, d):
    o = conv(spark, d).groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("op"), F.bool_or(F.col("role") == "system").alias("scripted"))
    return o.groupBy("scripted").agg(F.count(F.lit(1)).alias("conversations"), r6(F.median(F.char_length("op"))).alias("median_opening"))


@query("message_before_reply", """SELECT conv_id, turn, md5(user_before) AS user_before FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS user_before FROM conversations) WHERE role = 'assistant'""")
def message_before_reply(spark, d):
    m = K.message_before(conv(spark, d), "conv_id", "turn", F.col("role") == "user", "text")
    return m.where("role = 'assistant'").select("conv_id", "turn", F.md5("user_before").alias("user_before"))


@query("results_of_calls", """WITH b AS (SELECT *, sum(CAST(role = 'assistant' AS INTEGER)) OVER w AS block FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, block ORDER BY turn) - 2 AS j,
  sum(CAST(role = 'system' AS INTEGER)) OVER (PARTITION BY conv_id, block ORDER BY turn) AS breaks FROM b WHERE block > 0)
SELECT conv_id, turn, block, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id, block) AS agent_idx, j FROM r QUALIFY role = 'user' AND breaks = 0""")
def results_of_calls(spark, d):
    """User messages standing in for tool results: each is tied to the agent turn it answers."""
    p = K.pair_results(conv(spark, d).select("conv_id", "turn", "role"), "conv_id", "turn", F.col("role") == "assistant", F.col("role") == "user")
    return p.select("conv_id", "turn", "block", "agent_idx", "j")


@query("communicated_infos", """WITH i AS (SELECT conv_id, list_distinct(list_filter(string_split(lower(min_by(text, turn)), ' '), lambda x: x <> '' AND substr(md5(x), 1, 1) < '4')) AS infos
  FROM conversations WHERE role = 'user' GROUP BY conv_id),
f AS (SELECT i.conv_id, info, coalesce(bool_or(contains(replace(lower(text), ',', ''), info)), false) AS said
  FROM (SELECT conv_id, unnest(infos) AS info FROM i) i LEFT JOIN conversations c ON c.conv_id = i.conv_id AND c.role = 'assistant' GROUP BY ALL)
SELECT conv_id, coalesce(bool_and(said), true) AS communicated FROM i LEFT JOIN f USING (conv_id) GROUP BY conv_id""")
def communicated_infos(spark, d):
    """The facts are a quarter of all words of the opening, by digest."""
    c = conv(spark, d)
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    words = F.filter(F.split(F.lower("op"), " "), lambda x: (x != "") & (F.substring(F.md5(x), 1, 1) < "4"))
    infos = c.groupBy("conv_id").agg(first.alias("op"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("role") == "user").alias("has")).where("has").select(
        "conv_id", "n", F.array_distinct(words).alias("infos"))
    out = K.communicated(c.where("role = 'assistant'"), infos, "conv_id", "text")
    return out.select("conv_id", F.coalesce("communicated", F.lit(False)).alias("communicated"))


@query("chat_message_rows", """SELECT conv_id, turn + 2 AS idx, role, CASE WHEN role = 'user' THEN 'call_' || conv_id || '_' || turn END AS ref, length(text) AS chars FROM conversations
UNION ALL SELECT DISTINCT conv_id, 0, 'system', NULL, 6 FROM conversations UNION ALL SELECT DISTINCT conv_id, 1, 'assistant', NULL, 29 FROM conversations""")
def chat_message_rows(spark, d):
    """Transcript rows with the fixed system and greeting messages in front."""
    c = conv(spark, d)
    body = c.select("conv_id", (F.col("turn") + 2).alias("idx"), "role",
                    F.when(F.col("role") == "user", F.concat_ws("_", F.lit("call"), "conv_id", "turn")).alias("ref"), F.char_length("text").cast("bigint").alias("chars"))
    head = c.select("conv_id").distinct().select("conv_id", F.explode(F.array(
        F.struct(F.lit(0).cast("bigint").alias("idx"), F.lit("system").alias("role"), F.lit("policy").alias("text")),
        F.struct(F.lit(1).cast("bigint").alias("idx"), F.lit("assistant").alias("role"), F.lit("Hi! How can I help you today?").alias("text")))).alias("m"))
    return body.unionByName(head.select("conv_id", "m.idx", "m.role", F.lit(None).cast("string").alias("ref"), F.char_length("m.text").cast("bigint").alias("chars")))


@query("conversation_run_summary", """WITH s AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS agent_turns, sum(length(text)) FILTER (role <> 'assistant') AS tin,
  sum(length(text)) FILTER (role = 'assistant') AS tout, max_by(role, turn) AS ending FROM conversations GROUP BY conv_id)
SELECT ending, count(*) AS episodes, round(avg(agent_turns), 6) AS agent_turns, round(sum(tin) * 1.0 / count(*), 6) AS prompt_chars, round(sum(tout) * 1.0 / count(*), 6) AS gen_chars FROM s GROUP BY ending""")
def conversation_run_summary(spark, d):
    agent = F.col("role") == "assistant"
    n = F.char_length("text")
    s = conv(spark, d).groupBy("conv_id").agg(F.count_if(agent).alias("turns"), F.sum(F.when(~agent, n)).alias("tin"), F.sum(F.when(agent, n)).alias("tout"), F.max_by("role", "turn").alias("ending"))
    k = F.count(F.lit(1))
    return s.groupBy("ending").agg(k.alias("episodes"), r6(F.avg("turns")).alias("agent_turns"), r6(F.sum("tin") / k).alias("prompt_chars"), r6(F.sum("tout") / k).alias("gen_chars"))


@query("tool_hints", EV + """SELECT tool, CASE WHEN NOT rejected THEN 'none' WHEN tool = 'purchase' AND value > 10 THEN 'swap' WHEN value < 5 THEN 'lookup' ELSE 'none' END AS hint, count(*) AS calls
FROM event_calls GROUP BY ALL""")
def tool_hints(spark, d):
    c = T.event_calls(spark, d)
    name = F.when((F.col("tool") == "purchase") & (F.col("value") > 10), X.SWAP_TOOLS[0]).otherwise(F.col("tool"))
    content = F.when(~F.col("rejected"), "{}").when(F.col("value") < 5, "Error: order not found").otherwise("Error: denied")
    h = X.tool_hint(name, content)
    return c.groupBy("tool", F.when(h == X.SWAP_HINT, "swap").when(h == X.LOOKUP_HINT, "lookup").otherwise("none").alias("hint")).agg(F.count(F.lit(1)).alias("calls"))
