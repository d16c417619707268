"""Episode-record queries: everything here is row-local on nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import calls as C
from tracemill.functions import episode as E
from tracemill.plans.registry import query, r6
from tracemill.sources import documents as D
from tracemill.sources import episodes as S
from tracemill.sources import tables as T

L = T.with_sql(D.LINES_SQL)
K = T.with_sql(D.TOKENS_SQL)


def _derived(spark, d):
    e = D.doc_episodes(spark, d).withColumn("calls", E.calls(F.col("turns")))
    e = e.withColumn("done", E.successful_writes(F.col("calls"))).withColumn("gw", E.gold_writes(F.col("gold")))
    return e.withColumn("pg", E.write_progress(F.col("done"), F.col("gw")))


METRIC_SQL = L + """,
per AS (SELECT doc_id, count(*) AS calls, count(*) FILTER (is_write AND ok) AS successful, count(*) FILTER (is_write AND rejected) AS rejected,
  min(i * 10 + j) FILTER (name = 'find_user_id_by_email') AS fa, min(i * 10 + j) FILTER (is_write) AS fw FROM calls GROUP BY doc_id),
rep AS (SELECT doc_id, sum(n - 1) AS repeated FROM (SELECT doc_id, name, target, detail, count(*) AS n FROM calls GROUP BY ALL) GROUP BY doc_id),
dk AS (SELECT doc_id, name, target, count(*) AS d FROM calls WHERE is_write AND ok GROUP BY ALL), gk AS (SELECT doc_id, name, target, count(*) AS g FROM gold GROUP BY ALL),
un AS (SELECT doc_id, sum(greatest(d - coalesce(g, 0), 0)) AS unrequested, bool_or(g IS NULL) AS off_target FROM dk LEFT JOIN gk USING (doc_id, name, target) GROUP BY doc_id),
mi AS (SELECT gk.doc_id, bool_or(dk.d IS NULL) AS missing FROM gk LEFT JOIN dk USING (doc_id, name, target) GROUP BY gk.doc_id),
dc AS (SELECT doc_id, name, target, detail, count(*) AS d FROM calls WHERE is_write AND ok GROUP BY ALL), gc AS (SELECT doc_id, name, target, detail, count(*) AS g FROM gold GROUP BY ALL),
ma AS (SELECT doc_id, sum(least(d, g)) AS matched FROM dc JOIN gc USING (doc_id, name, target, detail) GROUP BY doc_id), gt AS (SELECT doc_id, count(*) AS total FROM gold GROUP BY doc_id),
m AS (SELECT docs.doc_id, lang, n_chars, coalesce(calls, 0) AS calls, coalesce(successful, 0) AS successful, coalesce(rejected, 0) AS rejected, coalesce(repeated, 0) AS repeated,
  CASE WHEN fw IS NOT NULL THEN coalesce(fa < fw, false) END AS auth_first, coalesce(unrequested, 0) AS unrequested, coalesce(matched, 0) AS matched, coalesce(total, 0) AS total,
  coalesce(successful, 0) - coalesce(matched, 0) AS wrong, coalesce(off_target, false) AS off_target, coalesce(missing, false) AS missing FROM docs LEFT JOIN per USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN un USING (doc_id)
  LEFT JOIN mi USING (doc_id) LEFT JOIN ma USING (doc_id) LEFT JOIN gt USING (doc_id)),
classed AS (SELECT *, CASE WHEN lang = 'en' AND n_chars <= 6000 THEN NULL WHEN n_chars > 6000 THEN 'runaway' WHEN off_target THEN 'wrong_target' WHEN missing THEN 'missed_write' WHEN wrong > 0 OR matched < total THEN 'wrong_args' ELSE 'other' END AS failure_class,
  CASE WHEN lang = 'en' AND n_chars <= 6000 THEN 1 ELSE 0 END AS er FROM m)"""


@query("episode_write_metrics", METRIC_SQL + "SELECT doc_id, calls, successful, rejected, repeated, auth_first, unrequested, matched, total, wrong, failure_class FROM classed")
def episode_write_metrics(spark, d):
    e = _derived(spark, d)
    return e.select("doc_id", F.size("calls").alias("calls"), F.size("done").alias("successful"), E.rejected_writes(F.col("calls")).alias("rejected"),
                    E.repeated_calls(F.col("calls")).alias("repeated"), E.auth_before_first_write(F.col("calls")).alias("auth_first"),
                    E.unrequested_writes(F.col("done"), F.col("gw")).alias("unrequested"), "pg.matched", "pg.total", "pg.wrong",
                    E.failure_class(F.col("reward"), F.col("termination"), F.col("done"), F.col("gw"), F.col("pg")).alias("failure_class"))


@query("episode_training_reward", METRIC_SQL + """SELECT doc_id, round(CASE WHEN er = 1 THEN 1 - least(0.2, 0.1 * (rejected + wrong)) - least(0.2, 0.05 * repeated)
  ELSE 0.3 * CASE WHEN total > 0 AND wrong = 0 THEN matched * 1.0 / total ELSE 0 END - least(0.2, 0.05 * repeated) - CASE WHEN unrequested > 0 THEN 0.5 ELSE 0 END END, 6) AS reward FROM classed""")
def episode_training_reward(spark, d):
    e = _derived(spark, d).select("doc_id", "pg", E.eval_reward(F.col("reward"), F.col("termination")).alias("er"), E.rejected_writes(F.col("calls")).alias("rej"),
                                  E.repeated_calls(F.col("calls")).alias("rep"), E.unrequested_writes(F.col("done"), F.col("gw")).alias("unreq"))
    return e.select("doc_id", r6(E.training_reward(F.col("er"), F.col("rej"), F.col("pg.wrong"), F.col("rep"), F.col("unreq"), F.col("pg"), F.lit(0.0),
                                                   partial_credit=0.3, unrequested_penalty=0.5, mistake_penalty=0.1, repeat_penalty=0.05)).alias("reward"))


CREDIT_SQL = L.replace("WITH ", "WITH RECURSIVE ", 1) + """,
listed AS (SELECT doc_id, name, target, row_number() OVER (PARTITION BY doc_id, name, target ORDER BY i) AS g, w2,
  list_distinct([w2 || '>' || w3, w3 || '>' || CASE WHEN substr(w4, 1, 1) < 'n' THEN w4 ELSE w5 END]) AS p FROM keyed WHERE j = 0 AND n >= 50 AND name NOT IN ('get_order_details', 'find_user_id_by_email')),
made AS (SELECT doc_id, name, target, i * 10 + j AS pos, w2, list_distinct([w2 || '>' || w3, w3 || '>' || w4]) AS p FROM calls WHERE is_write AND ok),
near AS (SELECT l.doc_id, l.name, l.target, g, pos, CASE WHEN l.name LIKE 'exch%' THEN len(list_intersect(l.p, m.p)) / greatest(len(l.p), len(m.p)) WHEN l.w2 = m.w2 THEN 1.0 ELSE 0.0 END AS c
  FROM listed l JOIN made m ON m.doc_id = l.doc_id AND m.name = l.name AND m.target = l.target),
choice AS (SELECT doc_id, name, target, g, list({'pos': pos, 'c': c} ORDER BY c DESC, pos) AS options FROM near GROUP BY ALL),
pick(doc_id, name, target, g, used, total) AS (SELECT DISTINCT doc_id, name, target, 0::BIGINT, []::BIGINT[], 0::DOUBLE FROM choice UNION ALL
  SELECT doc_id, name, target, g + 1, CASE WHEN o IS NULL THEN used ELSE list_append(used, o.pos) END, total + coalesce(o.c, 0) FROM (
    SELECT k.*, list_filter(c.options, lambda x: NOT list_contains(k.used, x.pos))[1] AS o FROM pick k JOIN choice c ON c.doc_id = k.doc_id AND c.name = k.name AND c.target = k.target AND c.g = k.g + 1)),
took AS (SELECT doc_id, sum(total) AS total, sum(len(used)) AS used FROM (SELECT * FROM pick QUALIFY g = max(g) OVER (PARTITION BY doc_id, name, target)) GROUP BY doc_id),
ng AS (SELECT doc_id, count(*) AS n FROM listed GROUP BY doc_id), nd AS (SELECT doc_id, count(*) AS n FROM made GROUP BY doc_id)
SELECT docs.doc_id, CASE WHEN ng.n IS NULL THEN 0.0 ELSE round(greatest(0.0, least(1.0, (coalesce(total, 0) - coalesce(nd.n, 0) + coalesce(used, 0)) / ng.n)), 6) END AS credit
FROM docs LEFT JOIN ng USING (doc_id) LEFT JOIN nd USING (doc_id) LEFT JOIN took USING (doc_id)"""


@query("graded_write_credit", CREDIT_SQL)
def graded_write_credit(spark, d):
    """Greedy closest match. The choice for a gold write depends on the earlier ones on the same tool and target, so the
    SQL takes them one by one, by recursion."""
    return _derived(spark, d).select("doc_id", r6(E.graded_credit(F.col("done"), F.col("gw"))).alias("credit"))


@query("targets_seen_before", L + """SELECT doc_id, i AS turn_idx, j AS call_idx, target, EXISTS (SELECT 1 FROM clean t WHERE t.doc_id = calls.doc_id AND t.i < calls.i AND t.role = 'tool' AND contains(CASE WHEN lower(substr(t.line, 1, 1)) < 'h' THEN 'Error: ' || t.line ELSE t.line END, target)) AS seen
FROM calls WHERE is_write""")
def targets_seen_before(spark, d):
    """Was the id of a write shown in an earlier tool result, or invented."""
    e = D.doc_episodes(spark, d)
    c = e.select("doc_id", "turns", F.explode(E.writes(E.calls(F.col("turns")))).alias("c"))
    return c.select("doc_id", "c.turn_idx", "c.call_idx", F.col("c.args")["order_id"].alias("target"),
                    E.seen_earlier(F.col("turns"), F.col("c.args")["order_id"], F.col("c.turn_idx")).alias("seen"))


@query("spoken_facts", """WITH docs AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: len(string_split(x, ' ')) >= 40) AS ls,
  list_distinct(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '' AND substr(md5(x), 1, 1) = '0')) AS infos FROM documents)
SELECT doc_id, len(list_filter(infos, lambda i: len(list_filter(ls, lambda l: contains(replace(lower(l), ',', ''), lower(i)))) = 0)) = 0 AS communicated FROM docs""")
def spoken_facts(spark, d):
    """Were the facts to communicate said in some agent message; a sixteenth of all words of the whole text, by digest, are its facts."""
    text = F.coalesce("text", F.lit(""))
    fact = F.array_distinct(F.filter(F.split(text, " "), lambda x: (x != "") & (F.substring(F.md5(x), 1, 1) == "0")))
    t = T.table(spark, d, "documents").select("doc_id", F.filter(F.split(text, "\n"), lambda x: F.size(F.split(x, " ")) >= D.AGENT_WORDS).alias("ls"), fact.alias("infos"))
    from tracemill.functions import text as X
    return t.select("doc_id", X.communicated(F.col("ls"), F.col("infos")).alias("communicated"))


@query("stricter_rule_rescore", """WITH t AS (SELECT source, lang = 'en' AND n_chars <= 6000 AS db_ok, contains(lower(text), 'with') AS said FROM documents)
SELECT source, count(*) AS episodes, round(avg(CAST(db_ok AS INTEGER)), 6) AS db_only, round(avg(CAST(db_ok AND said AS INTEGER)), 6) AS strict, count(*) FILTER (db_ok AND NOT said) AS flipped,
  round(count(*) FILTER (db_ok AND NOT said) * 1.0 / count(*), 6) AS unsaid FROM t GROUP BY source""")
def stricter_rule_rescore(spark, d):
    """Success on the final state alone against success that also needs the fact said."""
    from tracemill.functions import text as X
    t = T.table(spark, d, "documents").select("source", ((F.col("lang") == "en") & (F.col("n_chars") <= 6000)).alias("db_ok"), X.communicated(F.array("text"), F.array(F.lit("with"))).alias("said"))
    strict = E.state_reward(F.col("db_ok"), F.col("said"), F.lit("natural"))
    unsaid = F.col("db_ok") & ~F.col("said")
    return t.groupBy("source").agg(F.count(F.lit(1)).alias("episodes"), r6(F.avg(F.col("db_ok").cast("int"))).alias("db_only"), r6(F.avg(strict)).alias("strict"),
                                   F.count_if(unsaid).alias("flipped"), r6(F.avg(unsaid.cast("int"))).alias("unsaid"))


# ------------------------------------------------------------------ token turns

@query("prefix_consistency", K + "SELECT doc_id, pairs, prefix_ok, mask_ok, single, single_tokens, per_turn FROM eps JOIN tot USING (doc_id)")
def prefix_consistency(spark, d):
    e = D.doc_token_turns(spark, d).withColumn("ch", E.pair_checks(F.col("turns")))
    return e.select("doc_id", F.size("ch").alias("pairs"), F.size(F.filter("ch", lambda c: c["prefix_ok"])).alias("prefix_ok"),
                    F.size(F.filter("ch", lambda c: c["mask_ok"])).alias("mask_ok"), E.is_single(F.col("ch")).alias("single"),
                    E.token_totals(F.col("turns"))["single"].alias("single_tokens"), E.token_totals(F.col("turns"))["per_turn"].alias("per_turn"))


@query("consistency_gate", K + """SELECT count(*) AS episodes, count(*) AS trainable, sum(pairs) AS turn_pairs, round(sum(prefix_ok) * 1.0 / sum(pairs), 6) AS prefix_ok_rate, round(sum(mask_ok) * 1.0 / sum(pairs), 6) AS mask_ok_rate,
  count(*) FILTER (single) AS single_sequence_episodes, round(avg(CAST(single AS INTEGER)), 6) AS single_sequence_rate, sum(single_tokens) AS tokens_single_sequence, sum(per_turn) AS tokens_per_turn,
  round(sum(per_turn) * 1.0 / sum(single_tokens), 6) AS compute_saving_x, CASE WHEN count(*) = 0 THEN 'NO_DATA' WHEN avg(CAST(single AS INTEGER)) >= 0.95 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM eps JOIN tot USING (doc_id)""")
def consistency_gate(spark, d):
    g = S.gate_report(D.doc_token_turns(spark, d).withColumn("termination", F.lit("natural")))
    return g.select(*[r6(F.col(c)).alias(c) if c.endswith(("_rate", "_x")) else F.col(c) for c in g.columns])


@query("failing_spans", K + """, bad AS (SELECT * FROM pairs WHERE NOT mask_ok QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k) = 1),
dv AS (SELECT *, coalesce((SELECT min(s) - 1 FROM (SELECT unnest(range(1, least(len(cp), len(np)) + 1)) AS s) WHERE cp[s] <> np[s]), CASE WHEN NOT prefix_ok THEN len(cp) END) AS apart FROM bad),
c AS (SELECT *, CASE WHEN apart > 0 THEN apart ELSE len(cp) END AS centre FROM dv)
SELECT doc_id, k AS turn_pair, prefix_ok, mask_ok, apart AS diverges_at, array_to_string(cp[greatest(centre - 8, 0) + 1:centre + 8], ',') AS expected, array_to_string(np[greatest(centre - 8, 0) + 1:centre + 8], ',') AS actual, 'tool' || k AS prior_tool_call FROM c""")
def failing_spans(spark, d):
    f = S.failing_spans(D.doc_token_turns(spark, d).withColumnRenamed("doc_id", "episode_id"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return f.select(F.col("episode_id").alias("doc_id"), "turn_pair", "prefix_ok", "mask_ok", "diverges_at", text("expected").alias("expected"), text("actual").alias("actual"), "prior_tool_call")


SEQ_SQL = K + """, seqs AS (SELECT eps.doc_id, 0 AS seq_idx, single_tokens AS length, trained FROM eps JOIN tot USING (doc_id) WHERE single
  UNION ALL SELECT arr.doc_id, k, b, b - a FROM arr JOIN eps USING (doc_id) WHERE NOT single)"""


@query("training_sequences", SEQ_SQL + """, pos AS (SELECT arr.doc_id, CASE WHEN single THEN 0 ELSE k END AS seq_idx, unnest(o) AS tok, unnest(range(a, b)) AS i FROM arr JOIN eps USING (doc_id)),
g AS (SELECT doc_id, seq_idx, sum(i - 1) AS position_sum, sum(tok) AS target_sum, round(sum(-(tok % 100) / 10.0), 4) AS lp_sum FROM pos GROUP BY ALL)
SELECT doc_id, seq_idx, length, trained, length > 600 AS too_long, coalesce(position_sum, 0) AS position_sum, coalesce(target_sum, 0) AS target_sum, coalesce(lp_sum, 0) AS lp_sum FROM seqs LEFT JOIN g USING (doc_id, seq_idx)""")
def training_sequences(spark, d):
    s = S.training_sequences(D.doc_token_turns(spark, d).withColumnRenamed("doc_id", "episode_id"), 600)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return s.select(F.col("episode_id").alias("doc_id"), "seq_idx", F.col("length").cast("bigint").alias("length"), F.size("targets").alias("trained"), "too_long",
                    total("positions").alias("position_sum"), total("targets").alias("target_sum"),
                    F.round(F.aggregate("behavior_lp", F.lit(0.0), lambda a, x: a + x), 4).alias("lp_sum"))


@query("entropy_proxy", K + """, t AS (SELECT source, unnest(o) AS tok FROM arr) SELECT source, count(*) AS tokens, round(avg((tok % 100) / 10.0), 6) AS mean_neg_logprob FROM t GROUP BY source""")
def entropy_proxy(spark, d):
    e = D.doc_token_turns(spark, d).select("source", E.neg_logprob_sum(F.col("turns")).alias("s"),
                                           F.aggregate("turns", F.lit(0).cast("bigint"), lambda a, t: a + F.size(t["token_ids"])).alias("n"))
    return e.groupBy("source").agg(F.sum("n").alias("tokens"), r6(F.sum("s") / F.sum("n")).alias("mean_neg_logprob"))


@query("sequence_summary", SEQ_SQL + "SELECT single, count(*) AS sequences, count(*) FILTER (length > 600) AS too_long, sum(trained) AS trained_tokens FROM seqs JOIN eps USING (doc_id) GROUP BY single")
def sequence_summary(spark, d):
    e = D.doc_token_turns(spark, d).withColumn("ch", E.pair_checks(F.col("turns")))
    s = e.select(E.is_single(F.col("ch")).alias("single"), F.explode(E.sequences(F.col("turns"), F.col("ch"))).alias("s"))
    return s.groupBy("single").agg(F.count(F.lit(1)).alias("sequences"), F.count_if(F.size("s.token_ids") > 600).alias("too_long"),
                                   F.sum(F.size(F.filter("s.loss_mask", lambda m: m))).alias("trained_tokens"))
