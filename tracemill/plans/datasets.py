"""Dataset-build queries: orders stand for tasks, their lines for gold actions, documents for texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import hashing as H
from tracemill.functions import text as X
from tracemill.operators import curation as C
from tracemill.operators import nearest as N
from tracemill.operators import sampling as S
from tracemill.plans.difficulty import uniform_sql
from tracemill.plans.registry import query, r6
from tracemill.sources import tables as T

KEY = ["tool", "target"]
SIG_SQL = """WITH sigs AS (SELECT l_orderkey AS task_id, l_returnflag || l_linestatus AS tool, CAST(l_partkey AS VARCHAR) || '/' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS target
  FROM lineitem WHERE l_returnflag <> 'A'),
parts AS (SELECT o_orderkey AS task_id, o_orderpriority AS family, o_totalprice AS price, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'held'
  WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN 'val' ELSE 'train' END AS part FROM orders),
held AS (SELECT DISTINCT tool, target FROM sigs JOIN parts USING (task_id) WHERE part = 'held'),
val AS (SELECT DISTINCT tool, target FROM sigs JOIN parts USING (task_id) WHERE part = 'val'),
in_held AS (SELECT DISTINCT task_id FROM sigs SEMI JOIN held USING (tool, target)), in_val AS (SELECT DISTINCT task_id FROM sigs SEMI JOIN val USING (tool, target))"""


def sigs(spark, d):
    li = T.table(spark, d, "lineitem").where("l_returnflag <> 'A'")
    return li.select(F.col("l_orderkey").alias("task_id"), F.concat("l_returnflag", "l_linestatus").alias("tool"),
                     F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string")).alias("target"))


def parts(spark, d):
    o = T.table(spark, d, "orders")
    p = (F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"), "held")
         .when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "O"), "val").otherwise("train"))
    return o.select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("family"), F.col("o_totalprice").alias("price"), p.alias("part"))


def _of(spark, d, part):
    return sigs(spark, d).join(parts(spark, d).where(F.col("part") == part).select("task_id"), "task_id", "left_semi")


@query("signature_collisions", SIG_SQL + """SELECT task_id, 'held' AS with_part FROM in_held SEMI JOIN (SELECT task_id FROM parts WHERE part = 'train') USING (task_id)
UNION ALL SELECT task_id, 'val' FROM in_val SEMI JOIN (SELECT task_id FROM parts WHERE part = 'train') USING (task_id)""")
def signature_collisions(spark, d):
    train = _of(spark, d, "train")
    return C.sharing_tasks(train, _of(spark, d, "held"), KEY).withColumn("with_part", F.lit("held")).unionByName(
        C.sharing_tasks(train, _of(spark, d, "val"), KEY).withColumn("with_part", F.lit("val")))


CASCADE_SQL = SIG_SQL + """,
acts AS (SELECT l_orderkey AS task_id, bool_or(l_discount = 0.1 AND l_tax = 0.08) AS replay_error, bool_or(l_quantity = 50) AND count(*) > 1 AS order_dependent,
  count(*) FILTER (l_returnflag <> 'A') AS writes FROM lineitem GROUP BY l_orderkey),
gold AS (SELECT task_id, list_sort(list(tool || ':' || target)) AS g FROM sigs GROUP BY task_id),
dup AS (SELECT task_id FROM (SELECT task_id, row_number() OVER (PARTITION BY g ORDER BY task_id) AS rn FROM gold) WHERE rn > 1),
verdicts AS (SELECT p.task_id, p.family, CASE WHEN price < 5000 THEN 'schema' WHEN replay_error THEN 'replay' WHEN coalesce(writes, 0) = 0 THEN 'no state change'
  WHEN h.task_id IS NOT NULL THEN 'shares a write with held-out' WHEN v.task_id IS NOT NULL THEN 'shares a write with val'
  WHEN order_dependent THEN 'end state depends on item order' WHEN u.task_id IS NOT NULL THEN 'same gold as an earlier task' END AS reason
  FROM parts p LEFT JOIN acts a ON a.task_id = p.task_id LEFT JOIN in_held h ON h.task_id = p.task_id LEFT JOIN in_val v ON v.task_id = p.task_id
  LEFT JOIN dup u ON u.task_id = p.task_id WHERE part = 'train')"""


def _verdicts(spark, d):
    """Flags per task, then the first failing check. Gold lists are compared by an order-free digest."""
    li = T.table(spark, d, "lineitem")
    acts = li.groupBy(F.col("l_orderkey").alias("task_id")).agg(
        F.bool_or((F.col("l_discount") == 0.1) & (F.col("l_tax") == 0.08)).alias("replay_error"),
        (F.bool_or(F.col("l_quantity") == 50) & (F.count(F.lit(1)) > 1)).alias("order_dependent"), F.count_if(F.col("l_returnflag") != "A").alias("writes"))
    gold = sigs(spark, d).groupBy("task_id").agg(*H.set_digest(F.concat_ws(":", "tool", "target")))
    first = gold.groupBy("n", "d1", "d2").agg(F.min("task_id").alias("task_id")).select("task_id", F.lit(True).alias("first"))
    s = sigs(spark, d)
    shared = C.leaks(s.join(parts(spark, d).select("task_id", "part"), "task_id"), KEY, ["held", "val"])
    j = parts(spark, d).where("part = 'train'").join(acts, "task_id", "left").join(shared, "task_id", "left").join(first, "task_id", "left")
    none = F.coalesce("writes", F.lit(0)) == 0
    return j.select("task_id", "family", C.first_failure({
        "schema": F.col("price") < 5000, "replay": F.col("replay_error"), "no state change": none,
        "shares a write with held-out": F.col("in_held"), "shares a write with val": F.col("in_val"),
        "end state depends on item order": F.col("order_dependent"), "same gold as an earlier task": F.col("first").isNull()}).alias("reason"))


@query("validation_cascade", CASCADE_SQL + "SELECT task_id, coalesce(reason, 'keep') AS reason FROM verdicts")
def validation_cascade(spark, d):
    return _verdicts(spark, d).select("task_id", F.coalesce("reason", F.lit("keep")).alias("reason"))


@query("drop_reason_counts", CASCADE_SQL + "SELECT family, coalesce(reason, 'keep') AS reason, count(*) AS tasks FROM verdicts GROUP BY ALL")
def drop_reason_counts(spark, d):
    return _verdicts(spark, d).groupBy("family", F.coalesce("reason", F.lit("keep")).alias("reason")).agg(F.count(F.lit(1)).alias("tasks"))


@query("write_count_report", SIG_SQL + """, w AS (SELECT parts.task_id, family, part, count(tool) AS writes FROM parts LEFT JOIN sigs USING (task_id) GROUP BY ALL)
SELECT family, part, count(*) AS tasks, round(avg(CAST(writes >= 3 AS INTEGER)), 6) AS many_writes, round(avg(CAST(writes = 0 AS INTEGER)), 6) AS no_write, round(avg(writes), 6) AS mean_writes FROM w GROUP BY family, part""")
def write_count_report(spark, d):
    """Shares of tasks with three or more writes and with none, per family and part."""
    n = sigs(spark, d).groupBy("task_id").agg(F.count(F.lit(1)).alias("writes"))
    w = parts(spark, d).select("task_id", "family", "part").join(n, "task_id", "left").withColumn("writes", F.coalesce("writes", F.lit(0)))
    return w.groupBy("family", "part").agg(F.count(F.lit(1)).alias("tasks"), r6(F.avg((F.col("writes") >= 3).cast("int"))).alias("many_writes"),
                                           r6(F.avg((F.col("writes") == 0).cast("int"))).alias("no_write"), r6(F.avg("writes")).alias("mean_writes"))


@query("unique_signature_tasks", SIG_SQL + """, own AS (SELECT DISTINCT task_id, tool, target FROM sigs),
n AS (SELECT tool, target, count(*) AS owners FROM own GROUP BY ALL)
SELECT task_id FROM own JOIN n USING (tool, target) GROUP BY task_id HAVING bool_and(owners = 1)""")
def unique_signature_tasks(spark, d):
    return C.unique_signature_tasks(sigs(spark, d), KEY)


@query("hard_validation_quota", SIG_SQL + """, own AS (SELECT DISTINCT task_id, tool, target FROM sigs), n AS (SELECT tool, target, count(*) AS owners FROM own GROUP BY ALL),
u AS (SELECT task_id FROM own JOIN n USING (tool, target) GROUP BY task_id HAVING bool_and(owners = 1)),
f AS (SELECT task_id, family, count(*) OVER (PARTITION BY family) AS size, row_number() OVER (PARTITION BY family ORDER BY md5('606:quota:' || CAST(task_id AS VARCHAR)), task_id) AS rn FROM u JOIN parts USING (task_id))
SELECT task_id, family FROM f WHERE rn <= greatest(4, CAST(round_even(0.15 * size, 0) AS INTEGER))""")
def hard_validation_quota(spark, d):
    u = C.unique_signature_tasks(sigs(spark, d), KEY).join(parts(spark, d).select("task_id", "family"), "task_id")
    return S.take_quota(u, "family", "task_id", 0.15, 4, 606)


WORDS = "[A-Za-z]{6,}"


@query("entity_overlap", f"""WITH a AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '{WORDS}')) AS ents FROM documents),
h AS (SELECT item_id, list_distinct(regexp_extract_all(text, '{WORDS}')) AS ents FROM benchmark),
p AS (SELECT doc_id, item_id, count(*) AS n, any_value(na) AS na, any_value(nh) AS nh FROM (SELECT doc_id, len(ents) AS na, unnest(ents) AS e FROM a)
  JOIN (SELECT item_id, len(ents) AS nh, unnest(ents) AS e FROM h) USING (e) GROUP BY ALL)
SELECT doc_id, round(coalesce(max(n * 1.0 / (na + nh - n)), 0), 6) AS overlap FROM a LEFT JOIN p USING (doc_id) GROUP BY doc_id""")
def entity_overlap(spark, d):
    a = T.table(spark, d, "documents").select("doc_id", X.entities(F.col("text"), WORDS).alias("entities"))
    h = T.table(spark, d, "benchmark").select("item_id", X.entities(F.col("text"), WORDS).alias("entities"))
    return N.best_overlap(a, h, "doc_id", "item_id").withColumn("overlap", r6(F.col("overlap")))


@query("entity_counts", f"SELECT source, sum(len(list_distinct(regexp_extract_all(text, '{WORDS}')))) AS entities, count(*) AS docs FROM documents GROUP BY source")
def entity_counts(spark, d):
    return T.table(spark, d, "documents").groupBy("source").agg(F.sum(F.size(X.entities(F.col("text"), WORDS))).alias("entities"), F.count(F.lit(1)).alias("docs"))


@query("structural_dedupe", """SELECT min(doc_id) AS doc_id, sha256(text) AS key FROM documents ANTI JOIN (SELECT DISTINCT text FROM benchmark) USING (text) GROUP BY text""")
def structural_dedupe(spark, d):
    earlier = T.table(spark, d, "benchmark").select(F.sha2("text", 256).alias("key"))
    return C.first_of_each(T.table(spark, d, "documents"), F.col("text"), "doc_id", earlier)


@query("clean_texts", """WITH c AS (SELECT doc_id, source, text, contains(text, 'Copyright') AS dropped, contains(text, 'the of') AS changed FROM documents)
SELECT source, CASE WHEN dropped THEN 'license' WHEN changed THEN 'reworded' ELSE 'kept' END AS outcome, count(*) AS docs,
  sum(length(CASE WHEN NOT dropped THEN replace(text, 'the of', 'of the very') || ' END' END)) AS chars FROM c GROUP BY ALL""")
def clean_texts(spark, d):
    c = C.clean_texts(T.table(spark, d, "documents").select("source", "text"), "text", {"license": "Copyright"}, {"reworded": ("the of", "of the very")}, " END")
    return c.groupBy("source", F.coalesce("dropped", "changed", F.lit("kept")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.char_length("text")).alias("chars"))


@query("length_filter", "SELECT source, count(*) AS sequences, count(*) FILTER (len(string_split(text, ' ')) > 600) AS too_long, sum(CASE WHEN len(string_split(text, ' ')) <= 600 THEN len(string_split(text, ' ')) ELSE 0 END) AS kept_tokens FROM documents GROUP BY source")
def length_filter(spark, d):
    t = T.table(spark, d, "documents").select("source", F.size(F.split("text", " ")).alias("n"))
    return t.groupBy("source").agg(F.count(F.lit(1)).alias("sequences"), F.count_if(F.col("n") > 600).alias("too_long"), F.sum(F.when(F.col("n") <= 600, F.col("n")).otherwise(0)).alias("kept_tokens"))


@query("sequence_length_stats", """WITH s AS (SELECT source, len(string_split(text, ' ')) AS n FROM documents)
SELECT source, max(n) AS longest, sum(n) AS total, quantile_disc(n, 0.5) AS lower_median, round(median(n), 6) AS median FROM s GROUP BY source""")
def sequence_length_stats(spark, d):
    """Token counts per source. Lengths are counted per value first, so the exact median needs only the
    value table."""
    from pyspark.sql import Window
    t = T.table(spark, d, "documents").groupBy("source", F.size(F.split("text", " ")).alias("n")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("source").orderBy("n")
    whole = Window.partitionBy("source")
    c = t.withColumn("hi", F.sum("k").over(w)).withColumn("all", F.sum("k").over(whole))

    def at(pos):  # value at a zero-based position
        return F.min(F.when(F.col("hi") > pos, F.col("n")))
    lo, up = at(F.floor((F.col("all") - 1) / 2)), at(F.ceil((F.col("all") - 1) / 2))
    return c.groupBy("source").agg(F.max("n").alias("longest"), F.sum(F.col("n") * F.col("k")).alias("total"), lo.alias("lower_median"), r6((lo + up) / 2).alias("median"))


@query("task_set_algebra", """WITH a AS (SELECT o_orderkey AS t FROM orders WHERE o_orderstatus <> 'F'), b AS (SELECT l_orderkey AS t FROM lineitem WHERE l_quantity > 40)
SELECT 'union' AS op, t AS task_id FROM (SELECT t FROM a UNION SELECT t FROM b) UNION ALL SELECT 'intersect', t FROM (SELECT t FROM a INTERSECT SELECT t FROM b)
UNION ALL SELECT 'except', t FROM (SELECT t FROM a EXCEPT SELECT t FROM b)""")
def task_set_algebra(spark, d):
    a = T.table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("task_id"))
    b = T.table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("task_id"))
    return (a.union(b).distinct().withColumn("op", F.lit("union")).unionByName(a.intersect(b).withColumn("op", F.lit("intersect")))
            .unionByName(a.subtract(b).withColumn("op", F.lit("except"))))


# ------------------------------------------------------------------ ids described in text

@query("described_orders", r"""WITH o AS (SELECT o_orderkey, o_custkey, '#W' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS id,
  'your ' || o_orderstatus || ' order of ' || lower(o_orderpriority) AS phrase FROM orders),
u AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, phrase) AS same FROM o), p AS (SELECT id, CASE WHEN same = 1 THEN phrase END AS phrase FROM u),
t AS (SELECT o_orderkey, id AS id1, '#W' || lpad(CAST(o_orderkey + 1 AS VARCHAR), 7, '0') AS id2 FROM o)
SELECT o_orderkey, 'Cancel ' || CASE WHEN p1.phrase IS NULL THEN 'order ' || id1 ELSE p1.phrase END || '. Return ' || CASE WHEN p2.phrase IS NULL THEN id2 ELSE 'items from ' || p2.phrase END || ' using your card' AS body,
  CAST(p1.phrase IS NOT NULL AS INTEGER) + CAST(p2.phrase IS NOT NULL AS INTEGER) AS described, CAST(p1.phrase IS NULL AS INTEGER) + CAST(p2.phrase IS NULL AS INTEGER) AS kept
FROM t LEFT JOIN p p1 ON p1.id = id1 LEFT JOIN p p2 ON p2.id = id2""")
def described_orders(spark, d):
    """Order ids in a text become descriptions when the description is unique among the customer's orders."""
    o = T.table(spark, d, "orders")
    wid = lambda c: F.concat(F.lit("#W"), F.lpad(c.cast("string"), 7, "0"))
    p = o.select(wid(F.col("o_orderkey")).alias("id"), "o_custkey", F.concat(F.lit("your "), "o_orderstatus", F.lit(" order of "), F.lower("o_orderpriority")).alias("phrase"))
    # only descriptions with one owner survive the aggregate; the rest stay ids
    phrases = p.groupBy("o_custkey", "phrase").agg(F.count(F.lit(1)).alias("same"), F.min("id").alias("id")).where("same = 1").select("id", "phrase")
    body = F.concat(F.lit("Cancel order "), wid(F.col("o_orderkey")), F.lit(". Return "), wid(F.col("o_orderkey") + 1), F.lit(" via your card"))
    return C.describe_ids(o.select("o_orderkey", body.alias("body")), "o_orderkey", "body", r"#W\d{7}", phrases)


@query("instruction_heads", """WITH c AS (SELECT c_custkey, c_mktsegment AS seg FROM customer)
SELECT c_custkey, seg <> 'MACHINERY' AS ok, CASE WHEN seg <> 'MACHINERY' THEN 'Cust ' || c_custkey ELSE '' END AS name, CASE WHEN seg IN ('BUILDING', 'AUTOMOBILE') THEN 'c' || c_custkey || '@x.org' END AS email,
  CASE WHEN seg NOT IN ('MACHINERY', 'BUILDING', 'AUTOMOBILE') THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0') END AS zip, CASE WHEN seg <> 'MACHINERY' THEN lower(seg) ELSE '' END AS traits,
  CASE WHEN seg <> 'MACHINERY' THEN 'Please help.' ELSE '' END AS body FROM c""")
def instruction_heads(spark, d):
    c = T.table(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    who = F.when(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"), F.concat(F.lit("email is c"), key, F.lit("@x.org"))).otherwise(F.concat(F.lit("zip code is "), F.lpad(key, 5, "0")))
    text = F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("I am "), key)).otherwise(
        F.concat(F.lit("Your name is Cust "), key, F.lit(" and your "), who, F.lit(". You are "), F.lower("c_mktsegment"), F.lit(".  Please help. ")))
    return c.select("c_custkey", X.instruction_head(text).alias("h")).select("c_custkey", "h.*")


# ------------------------------------------------------------------ sampling

STRATA_SQL = "strata AS (SELECT p_partkey AS task_id, p_brand || '/' || CAST(least(CAST(floor(p_size / 20) AS INTEGER), 3) AS VARCHAR) AS stratum FROM part)"
CARVE_SQL = "WITH " + STRATA_SQL + """,
s AS (SELECT stratum, count(*) AS size FROM strata GROUP BY stratum), e AS (SELECT *, size * 60.0::DOUBLE / sum(size) OVER () AS exact FROM s),
f AS (SELECT *, CAST(floor(exact) AS BIGINT) AS base, exact - floor(exact) AS frac FROM e),
a AS (SELECT stratum, base + CASE WHEN row_number() OVER (ORDER BY frac DESC, stratum) <= 60 - sum(base) OVER () THEN 1 ELSE 0 END AS alloc FROM f),
carved AS (SELECT task_id, stratum, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY md5('300:carve:' || CAST(task_id AS VARCHAR)), task_id) <= alloc THEN 'val' ELSE 'train' END AS part
  FROM strata JOIN a USING (stratum))"""


def _carved(spark, d):
    s = T.table(spark, d, "part").select(F.col("p_partkey").alias("task_id"), F.concat_ws("/", "p_brand", F.least(F.floor(F.col("p_size") / 20).cast("int"), F.lit(3)).cast("string")).alias("stratum"))
    return S.carve(s, "stratum", "task_id", 60)


@query("stratified_carve", CARVE_SQL + "SELECT task_id, stratum, part FROM carved")
def stratified_carve(spark, d):
    return _carved(spark, d)


@query("split_drift", CARVE_SQL + ", n AS (SELECT part, stratum, count(*) AS tasks FROM carved GROUP BY ALL) SELECT part, stratum, tasks, round(100.0 * tasks / sum(tasks) OVER (PARTITION BY part), 6) AS share_pct FROM n")
def split_drift(spark, d):
    n = _carved(spark, d).groupBy("part", "stratum").agg(F.count(F.lit(1)).alias("tasks"))
    tot = n.groupBy("part").agg(F.sum("tasks").alias("all"))
    return n.join(tot, "part").select("part", "stratum", "tasks", r6(100.0 * F.col("tasks") / F.col("all")).alias("share_pct"))


@query("split_check", CARVE_SQL + "SELECT CAST(count(*) AS HUGEINT) AS rows, count(DISTINCT task_id) AS tasks, 0 AS in_two_parts, 0 AS repeated FROM carved")
def split_check(spark, d):
    return C.split_check(C.require_disjoint(_carved(spark, d).select("task_id", "part")))


@query("rebalanced_pool", """WITH n AS (SELECT count(*) AS n FROM part), r AS (SELECT p_partkey AS task_id, p_type AS cls, row_number() OVER (PARTITION BY p_type ORDER BY md5('606:rebalance:' || CAST(p_partkey AS VARCHAR)), p_partkey) AS rn FROM part)
SELECT task_id, cls FROM r, n WHERE cls NOT IN ('PROMO', 'SMALL') OR (cls = 'PROMO' AND rn <= round_even(0.12 * n, 0)) OR (cls = 'SMALL' AND rn <= round_even(0.05 * n, 0))""")
def rebalanced_pool(spark, d):
    p = T.table(spark, d, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_type").alias("cls"))
    return S.rebalance(p, F.col("cls"), "task_id", {"PROMO": 0.12, "SMALL": 0.05}, 606)


@query("random_cases", "SELECT p_partkey AS task_id, p_name FROM part ORDER BY md5('29:cases:' || CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 20")
def random_cases(spark, d):
    return S.sample_n(T.table(spark, d, "part").select(F.col("p_partkey").alias("task_id"), "p_name"), "task_id", 20, 29, "cases")


WON_SQL = """won AS (SELECT l_partkey AS task_id, l_linestatus AS run, l_tax, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS episode_id FROM lineitem WHERE l_returnflag = 'R')"""


@query("one_success_per_task", "WITH " + WON_SQL + """, one AS (SELECT task_id, min_by(episode_id, md5('7:pick:' || episode_id)) AS episode_id FROM won WHERE run = 'O' GROUP BY task_id)
SELECT task_id, episode_id FROM one QUALIFY row_number() OVER (ORDER BY md5('7:cap:' || episode_id), episode_id) <= (SELECT count(DISTINCT task_id) FROM won WHERE run = 'F' AND l_tax < 0.04)""")
def one_success_per_task(spark, d):
    """A model's own successes, one a task, but no more of them than the teacher solved tasks."""
    won = T.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("task_id"), "l_linestatus", "l_tax", F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("episode_id"))
    taught = won.where("l_linestatus = 'F' AND l_tax < 0.04").agg(F.count_distinct("task_id")).scalar()
    return S.capped(S.one_per_key(won.where("l_linestatus = 'O'"), "task_id", "episode_id", 7, "pick"), "episode_id", taught, 7, "cap")


@query("example_batches", """WITH t AS (SELECT DISTINCT source FROM documents), h AS (SELECT source FROM t ORDER BY md5('0:held:' || source), source LIMIT 3),
r AS (SELECT doc_id, source, row_number() OVER (ORDER BY md5('0:shuffle:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents ANTI JOIN h USING (source))
SELECT doc_id, source, CAST(floor((rn - 1) / 16) AS BIGINT) AS batch FROM r""")
def example_batches(spark, d):
    return S.example_batches(T.table(spark, d, "documents").select("doc_id", "source"), "doc_id", "source", 16, 3, 0)


def choice_sql(u: str, opts: dict[str, float]) -> str:
    tot, acc, out, names = sum(opts.values()), 0.0, "", list(opts)
    for n in names[:-1]:
        acc += opts[n] / tot
        out += f" WHEN {u} < {acc!r} THEN '{n}'"
    return f"CASE{out} ELSE '{names[-1]}' END"


PERSONAS = {"terse": 2.0, "forthcoming": 1.0, "impatient": 0.5, "uncertain": 0.5}
CUSTOMERS = {"first": 0.7, "second": 0.3}


@query("rollout_slots", f"""WITH g AS (SELECT p_size AS batch_id, p_partkey AS task_id, 'b' || lpad(CAST(p_size AS VARCHAR), 4, '0') || '-g' ||
  lpad(CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS VARCHAR), 3, '0') || '-' || CAST(p_partkey AS VARCHAR) AS group_id FROM part),
s AS (SELECT *, {choice_sql(uniform_sql(5, 'persona', 'group_id'), PERSONAS)} AS persona, {choice_sql(uniform_sql(5, 'customer', 'group_id'), CUSTOMERS)} AS customer, unnest(range(4)) AS trial FROM g)
SELECT *, group_id || '-k' || trial AS episode_id, CAST(floor({uniform_sql(5, 'slot', "(group_id || '-k' || trial)")} * 2147483648.0) AS BIGINT) AS seed FROM s""")
def rollout_slots(spark, d):
    t = T.table(spark, d, "part").select(F.col("p_size").alias("batch_id"), F.col("p_partkey").alias("task_id"))
    return S.rollout_slots(t, "batch_id", "task_id", 4, 5, PERSONAS, CUSTOMERS)


@query("resume_plan", """WITH w AS (SELECT p_partkey AS task_id, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part),
done AS (SELECT l_partkey AS task_id FROM lineitem GROUP BY l_partkey HAVING count(*) >= 30)
SELECT task_id, CASE WHEN n >= 192 THEN 3 WHEN n >= 112 THEN 2 WHEN n >= 48 THEN 1 ELSE 0 END AS chunk FROM w ANTI JOIN done USING (task_id)""")
def resume_plan(spark, d):
    return S.resume_plan(T.table(spark, d, "part").select(F.col("p_partkey").alias("task_id")), T.table(spark, d, "lineitem").select(F.col("l_partkey").alias("task_id")),
                         "task_id", 30, [0, 48, 112, 192])
