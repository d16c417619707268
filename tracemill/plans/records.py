"""Source and sink queries: text forms of the tables are written as JSON and read back through the same
parsers the file readers use."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.plans.registry import query, r6
from tracemill.session import work_folder
from tracemill.sources import episodes as EP
from tracemill.sources import runs as R
from tracemill.sources import schema as SC
from tracemill.sources import tables as T


@query("ledger_scan", """SELECT event_type AS what, count(*) FILTER (value < 40) AS lines, count(*) FILTER (value >= 40) AS corrupt, round(sum(CASE WHEN value < 2 THEN 0 WHEN value < 40 THEN value ELSE 0 END), 4) AS usd
FROM events WHERE value >= 1 GROUP BY event_type""")
def ledger_scan(spark, d):
    """A ledger with blank lines, torn lines, NUL tails and lines without an amount."""
    ev = T.table(spark, d, "events").select("event_type", "value", F.col("ts").cast("string").alias("at"))
    whole = F.to_json(F.struct("at", F.when(F.col("value") >= 2, F.col("value")).alias("usd"), F.col("event_type").alias("what")))
    line = (F.when(F.col("value") < 1, " \x00").when(F.col("value") >= 40, F.substring(whole, 1, 20)).when(F.col("value") >= 20, F.concat(whole, F.lit("\x00\x00"))).otherwise(whole))
    p = R.parse_ledger(ev.select("event_type", line.alias("value")))
    return p.groupBy(F.col("event_type").alias("what")).agg(
        F.count_if(~F.col("corrupt")).alias("lines"), F.count_if("corrupt").alias("corrupt"), F.round(F.coalesce(F.sum("usd"), F.lit(0.0)), 4).alias("usd"))


@query("damaged_lines", """SELECT event_type AS source, count(*) FILTER (value >= 20 AND value < 40) AS bad_lines, max(user_id) AS last_step FROM events GROUP BY event_type HAVING count(*) FILTER (value >= 20 AND value < 40) > 0 AND max(user_id) <> 148""")
def damaged_lines(spark, d):
    ev = T.table(spark, d, "events")
    line = F.when((F.col("value") >= 20) & (F.col("value") < 40), F.concat("props", F.lit("\x00"))).otherwise(F.col("props"))
    bad = ev.select(F.col("event_type").alias("source"), line.alias("l")).groupBy("source").agg(F.count_if(F.contains("l", F.lit("\x00"))).alias("bad_lines")).where("bad_lines > 0")
    steps = ev.select(F.col("event_type").alias("run"), F.col("user_id").alias("step"))
    ck = steps.select("run").distinct().withColumn("ckpt_step", F.lit(149))
    return bad.join(R.step_mismatch(steps, ck).select(F.col("run").alias("source"), "last_step"), "source")


def episode_lines(spark, d, *keep):
    """Each rollout as the JSON text of an episode record, some with faults; ``keep``: columns that stay beside it."""
    li = T.table(spark, d, "lineitem")
    out = F.array(F.lit(1), F.lit(2), F.lit(3))
    lps = F.when(F.col("l_tax") == 0.08, F.array(F.lit(-0.1))).otherwise(F.array(F.lit(-0.1), F.lit(-0.2), F.lit(-0.3)))
    turn = F.struct(F.lit("a").alias("_k"), F.lit("assistant").alias("role"), out.alias("prompt_token_ids"), out.alias("token_ids"), lps.alias("logprobs"), F.lit("hi").alias("text"))
    return li.select(F.to_json(F.struct(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("episode_id"), F.col("l_suppkey").alias("batch_id"), F.col("l_partkey").cast("string").alias("task_id"),
        F.col("l_orderkey").cast("string").alias("group_id"), F.array(turn).alias("turns"), F.when(F.col("l_quantity") == 50, 2).otherwise(1).alias("reward"),
        F.when(F.col("l_discount") == 0.1, "nope").otherwise("natural").alias("termination"), F.when(F.col("l_tax") == 0.0, 2).otherwise(1).alias("schema_version"))).alias("value"), *([*keep, "l_suppkey"] if keep else []))


@query("record_quarantine", """SELECT CASE WHEN l_tax = 0 THEN 'schema_version' WHEN l_tax = 0.08 THEN 'logprob_length' WHEN l_discount = 0.1 THEN 'termination' WHEN l_quantity = 50 THEN 'reward' ELSE 'sound' END AS fault,
  count(*) AS episodes, count(DISTINCT l_suppkey) AS batches FROM lineitem GROUP BY ALL""")
def record_quarantine(spark, d):
    rec = episode_lines(spark, d).select(F.from_json("value", SC.EPISODE).alias("e")).select("e.*").withColumn("turns", SC.normalise_turns(F.col("turns")))
    tagged = rec.select("batch_id", SC.record_fault(F.col("schema_version"), F.col("termination"), F.col("reward"), SC.turn_arrays_match(F.col("turns"))).alias("fault"))
    return tagged.groupBy(F.coalesce("fault", F.lit("sound")).alias("fault")).agg(F.count(F.lit(1)).alias("episodes"), F.count_distinct("batch_id").alias("batches"))


@query("episode_store_through_checkpoint", "SELECT l_suppkey AS batch_id, count(*) AS episodes, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS reward FROM lineitem WHERE l_suppkey <= 40 GROUP BY ALL")
def episode_store_through_checkpoint(spark, d):
    """Write the episode table by batch, then read the records up to a checkpoint: a partition filter."""
    path = work_folder(spark, "episodes")
    t = T.rollouts(spark, d)
    EP.write_episodes(t, path)
    kept = EP.keep_through(spark.read.parquet(path), 40)
    return kept.groupBy(F.col("batch_id").cast("bigint").alias("batch_id")).agg(F.count(F.lit(1)).alias("episodes"), F.sum("reward").alias("reward"))


def simulation_lines(spark, d):
    li = T.table(spark, d, "lineitem")
    usage = F.struct((F.col("l_quantity") * 100).cast("bigint").alias("prompt_tokens"), F.when(F.col("l_tax") > 0.02, F.col("l_quantity").cast("bigint")).alias("completion_tokens"))
    msg = lambda role, u: F.struct(F.lit(role).alias("role"), u.alias("usage"), F.array(F.struct(F.lit("think").alias("name"))).alias("tool_calls"))
    info = F.when(F.col("l_discount") > 0, F.struct(F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0).alias("reward"), F.struct(F.when(F.col("l_returnflag") == "A", 0.0).otherwise(1.0).alias("db_reward")).alias("db_check")))
    sim = F.struct(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_partkey").cast("string").alias("task_id"), info.alias("reward_info"),
                   F.when(F.col("l_tax") == 0, "TerminationReason.max_steps").otherwise("TerminationReason.user_stop").alias("termination_reason"), F.when(F.col("l_tax") > 0, F.col("l_quantity")).alias("duration"),
                   F.array(msg("user", usage), msg("assistant", usage), msg("assistant", usage)).alias("messages"))
    return li.select(F.col("l_linestatus").alias("run"), F.to_json(sim).alias("value"))


@query("simulation_scan", """SELECT l_linestatus AS run, CASE WHEN l_tax = 0 THEN 'max_steps' ELSE 'user_stop' END AS ending, count(*) AS episodes, count(*) FILTER (l_discount = 0) AS dead,
  round(avg(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) FILTER (l_discount > 0), 6) AS reward, round(avg(CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END) FILTER (l_discount > 0), 6) AS db_reward,
  2.0::DOUBLE AS agent_turns, round(avg(2 * CAST(l_quantity * 100 AS BIGINT)), 6) AS prompt_tokens, round(avg(CASE WHEN l_tax > 0.02 THEN 2 * CAST(l_quantity AS BIGINT) ELSE 0 END), 6) AS completion_tokens,
  round(avg(CASE WHEN l_tax > 0 THEN l_quantity ELSE 0 END), 6) AS sec_per_episode FROM lineitem GROUP BY ALL""")
def simulation_scan(spark, d):
    s = R.flatten_simulation(simulation_lines(spark, d).select("run", F.from_json("value", SC.SIMULATION).alias("s")), "s")
    ok = F.col("scored")
    return s.groupBy("run", "ending").agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if(~ok).alias("dead"), r6(F.avg(F.when(ok, F.col("reward")))).alias("reward"), r6(F.avg(F.when(ok, F.col("db_reward")))).alias("db_reward"),
        r6(F.avg("agent_turns")).alias("agent_turns"), r6(F.avg("prompt_tokens")).alias("prompt_tokens"), r6(F.avg("completion_tokens")).alias("completion_tokens"), r6(F.avg("duration")).alias("sec_per_episode"))


@query("checkpoint_union_costs", """WITH m AS (SELECT event_id AS id, CASE WHEN value > 5 THEN value END AS c, 0 AS rank FROM events WHERE event_type <> 'view' UNION ALL SELECT event_id, value * 2, 1 FROM events WHERE event_type <> 'click')
SELECT id, coalesce(arg_min(coalesce(c, 0), rank), 0) AS usd FROM m GROUP BY id""")
def checkpoint_union_costs(spark, d):
    ev = T.table(spark, d, "events")
    mono = ev.where("event_type <> 'view'").select(F.col("event_id").alias("id"), F.when(F.col("value") > 5, F.col("value")).alias("user_cost"))
    single = ev.where("event_type <> 'click'").select(F.col("event_id").alias("id"), (F.col("value") * 2).alias("user_cost"))
    return R.run_costs(mono, single)


@query("profile_maps", "SELECT CAST(p_partkey AS VARCHAR) || s AS task_id, p_size AS successes, p_size + n AS trials FROM part, (VALUES ('a', 1), ('b', 0)) AS v(s, n)")
def profile_maps(spark, d):
    p = T.table(spark, d, "part")
    k, s = F.col("p_partkey").cast("string"), F.col("p_size")
    doc = F.to_json(F.create_map(F.concat(k, F.lit("a")), F.struct(s.alias("successes"), (s + 1).alias("trials")), F.concat(k, F.lit("b")), F.struct(s.alias("successes"), s.alias("trials"))))
    return p.select(F.explode(R.count_map(doc)).alias("task_id", "c")).select("task_id", "c.successes", "c.trials")


@query("split_lists", "SELECT CAST(o_orderkey AS VARCHAR) AS task_id, CASE WHEN o_orderstatus = 'F' THEN 'val' ELSE 'train' END AS part FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'all' FROM orders")
def split_lists(spark, d):
    o = T.table(spark, d, "orders")
    k = F.col("o_orderkey").cast("string")
    doc = F.to_json(F.create_map(F.when(F.col("o_orderstatus") == "F", "val").otherwise("train"), F.array(k), F.lit("all"), F.array(k)))
    return o.select(F.inline(R.split_rows(doc)))


@query("store_variants", "SELECT p_brand AS product_id, p_type AS product_name, CAST(p_partkey AS VARCHAR) AS item_id, CAST(p_size AS VARCHAR) AS size, p_size <> 13 AS available, p_retailprice AS price FROM part")
def store_variants(spark, d):
    p = T.table(spark, d, "part")
    v = F.struct(F.col("p_partkey").cast("string").alias("item_id"), F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("options"), (F.col("p_size") != 13).alias("available"), F.col("p_retailprice").alias("price"))
    doc = F.to_json(F.struct(F.col("p_brand").alias("product_id"), F.col("p_type").alias("name"), F.create_map(F.col("p_partkey").cast("string"), v).alias("variants")))
    return R.product_variants(p.select(doc.alias("doc")), "doc").select("product_id", "product_name", "item_id", F.col("options")["size"].alias("size"), "available", "price")


@query("store_payments", """SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS first_name, CAST(c_nationkey AS VARCHAR) AS city, pid || c_custkey AS payment_id, src AS source, CASE WHEN src = 'gift_card' THEN c_acctbal END AS balance
FROM customer, (VALUES ('g', 'gift_card'), ('c', 'credit_card')) AS v(pid, src)""")
def store_payments(spark, d):
    c = T.table(spark, d, "customer")
    k = F.col("c_custkey").cast("string")
    pm = F.create_map(F.concat(F.lit("g"), k), F.struct(F.lit("gift_card").alias("source"), F.col("c_acctbal").alias("balance")), F.concat(F.lit("c"), k), F.struct(F.lit("credit_card").alias("source"), F.lit(None).cast("double").alias("balance")))
    doc = F.to_json(F.struct(k.alias("user_id"), F.struct(F.col("c_name").alias("first_name")).alias("name"), F.struct(F.col("c_nationkey").cast("string").alias("city")).alias("address"), pm.alias("payment_methods")))
    return R.user_payments(c.select(doc.alias("doc")), "doc")


@query("converted_tasks", """SELECT 'tb_' || CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 4 THEN lpad(CAST(c_custkey AS VARCHAR), 4, '0') ELSE CAST(c_custkey AS VARCHAR) END AS id, c_name AS instructions, j AS pos,
  'tb_' || CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 4 THEN lpad(CAST(c_custkey AS VARCHAR), 4, '0') ELSE CAST(c_custkey AS VARCHAR) END || '_' || j AS action_id, CASE WHEN j = 0 THEN 'get_user_details' ELSE lower(c_mktsegment) END AS name, 'DB,COMMUNICATE' AS basis
FROM customer, (SELECT unnest(range(2)) AS j)""")
def converted_tasks(spark, d):
    c = T.table(spark, d, "customer")
    acts = F.array(F.struct(F.lit("get_user_details").alias("name"), F.lit("{}").alias("kwargs")), F.struct(F.lower("c_mktsegment").alias("name"), F.lit("{}").alias("kwargs")))
    t = c.select(R.convert_task(F.col("c_custkey"), F.col("c_name"), acts, F.array().cast("array<string>")).alias("t"))
    return t.select("t.id", "t.instructions", F.posexplode("t.actions").alias("pos", "a"), F.array_join("t.reward_basis", ",").alias("basis")).select("id", "instructions", "pos", "a.action_id", "a.name", "basis")


@query("metrics_append", """SELECT l_suppkey AS step, l_linenumber AS repeat, round(avg(l_quantity), 6) AS mean FROM lineitem WHERE l_linestatus = 'F'
  AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal < 2000 AND l_linenumber <= 3) GROUP BY ALL""")
def metrics_append(spark, d):
    """New log rows whose step and repeat are not logged yet."""
    new = T.table(spark, d, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_suppkey").alias("step"), F.col("l_linenumber").alias("repeat")).agg(r6(F.avg("l_quantity")).alias("mean"))
    log = T.table(spark, d, "supplier").where("s_acctbal < 2000").select(F.col("s_suppkey").alias("step"), F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("repeat"))
    return R.not_logged(new, log, ["step", "repeat"])


# ------------------------------------------------------------------ files

@query("episode_files", """SELECT 'run' || l_linenumber % 2 AS run, 'batch=b' || l_suppkey % 8 AS batch_dir, CASE WHEN l_linestatus = 'F' AND l_quantity < 5 THEN 'unreadable' WHEN l_tax = 0 THEN 'schema_version' WHEN l_tax = 0.08 THEN 'logprob_length'
  WHEN l_discount = 0.1 THEN 'termination' WHEN l_quantity = 50 THEN 'reward' ELSE 'sound' END AS fault, count(*) AS episodes FROM lineitem GROUP BY ALL""")
def episode_files(spark, d):
    """Episode files of two runs are written in a folder for each batch, some records torn. They are read back with run and batch from the path, and each record gets its fault."""
    from tracemill.sources.episodes import EPISODE_FILES, read_episodes, with_run_and_batch
    root = work_folder(spark, "episode-files")
    lines = episode_lines(spark, d, "l_linenumber", "l_linestatus", "l_quantity")
    text = F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") < 5), F.substring("value", 1, 60)).otherwise(F.col("value"))
    run = F.concat(F.lit("run"), (F.col("l_linenumber") % 2).cast("string"))
    dealt = lines.select(text.alias("value"), run.alias("run"), F.concat(F.lit("b"), (F.col("l_suppkey") % 8).cast("string")).alias("batch"))
    for name in ("run0", "run1"):
        dealt.where(F.col("run") == name).select("value", "batch").hint("rebalance", "batch").write.option("compression", "gzip").partitionBy("batch").text(f"{root}/{name}/records")
    rec = with_run_and_batch(read_episodes(spark, root, recursive=True, pattern=EPISODE_FILES.replace("json", "txt")))
    tagged = rec.select("run", "batch_dir", SC.record_fault(F.col("schema_version"), F.col("termination"), F.col("reward"), SC.turn_arrays_match(F.col("turns")), F.col("_corrupt_record")).alias("fault"))
    return tagged.groupBy("run", "batch_dir", F.coalesce("fault", F.lit("sound")).alias("fault")).agg(F.count(F.lit(1)).alias("episodes"))


@query("ledger_files", """SELECT event_type AS what, count(*) AS lines, round(sum(round(value, 6)), 4) AS usd FROM events GROUP BY event_type""")
def ledger_files(spark, d):
    """Spend is appended to a ledger in two writes and read back."""
    path = work_folder(spark, "ledger")
    ev = T.table(spark, d, "events").select(F.col("ts").cast("string").alias("at"), F.col("value").alias("usd"), F.col("event_type").alias("what"))
    R.append_ledger(ev.where("what = 'view'"), path)
    R.append_ledger(ev.where("what <> 'view'"), path)
    p = R.read_ledger(spark, path).where("NOT corrupt")
    return p.groupBy("what").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("usd"), 4).alias("usd"))


# ------------------------------------------------------------------ the store as flat tables

@query("store_orders", "WITH " + T.ITEMS_SQL + """ SELECT CAST(order_id AS VARCHAR) AS order_id, 'u' || user_id AS user_id, status, city, count(*) AS items, round(sum(price), 2) AS total,
  count(DISTINCT product) AS products, round(max(total), 2) AS paid FROM items GROUP BY order_id, user_id, status, city""")
def store_orders(spark, d):
    """Orders as nested documents, flattened to orders, their items and their payments."""
    it = T.order_items(spark, d)
    item = F.struct(F.col("item_id").cast("string").alias("item_id"), F.col("product").alias("product_id"), F.col("product").alias("name"), "price", "options")
    docs = it.groupBy("order_id", "user_id", "status", "city").agg(F.collect_list(item).alias("items"), F.max("total").alias("paid"))
    pay = F.array(F.struct(F.lit("payment").alias("transaction_type"), F.col("paid").alias("amount"), F.lit("c1").alias("payment_method_id")))
    doc = F.to_json(F.struct(F.col("order_id").cast("string").alias("order_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"), "status",
                             F.struct("city").alias("address"), "items", pay.alias("payment_history")))
    flat = R.flat_orders(docs.select(doc.alias("doc")), "doc")
    per = flat["order_items"].groupBy("order_id").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("price"), 2).alias("total"), F.count_distinct("product_id").alias("products"))
    paid = flat["order_payments"].groupBy("order_id").agg(F.round(F.sum("amount"), 2).alias("paid"))
    return flat["orders"].select("order_id", "user_id", "status", "city").join(per, "order_id", "left").join(paid, "order_id", "left")


# ------------------------------------------------------------------ typed arguments

@query("typed_arguments", """WITH a AS (SELECT l_returnflag, l_partkey AS k, l_linenumber % 6 AS kind, l_discount FROM lineitem)
SELECT l_returnflag AS flag, count(*) FILTER (kind = 4 OR kind = 5 AND l_discount >= 0.05) AS parse_errors, count(*) FILTER (kind = 0 OR kind = 3) AS equal_to_gold, count(*) FILTER (kind = 2) AS lists,
  count(*) FILTER (kind = 5 AND l_discount < 0.05) AS empty, count(DISTINCT CASE WHEN kind IN (0, 1, 3) THEN (CASE WHEN kind = 1 THEN 's' ELSE 'n' END) || k END) AS keys FROM a GROUP BY l_returnflag""")
def typed_arguments(spark, d):
    """Arguments of mixed types against gold: a number, the same digits as text, a list, the fields in another order, torn
    text and blank text."""
    from tracemill.functions import calls as C
    k, kind = F.col("l_partkey").cast("string"), F.col("l_linenumber") % 6
    text = (F.when(kind == 0, F.concat(F.lit('{"order_id": "o", "count": '), k, F.lit("}")))
            .when(kind == 1, F.concat(F.lit('{"order_id": "o", "count": "'), k, F.lit('"}')))
            .when(kind == 2, F.concat(F.lit('{"order_id": "o", "item_ids": ["'), k, F.lit('", 7]}')))
            .when(kind == 3, F.concat(F.lit('{"count":'), k, F.lit(', "order_id":"o"}')))
            .when(kind == 4, F.concat(F.lit('{"order_id": "o", "count": '), k)).otherwise(F.when(F.col("l_discount") < 0.05, " ").otherwise('{"a": 1} and more')))
    call = F.array(F.struct(F.lit(None).cast("string").alias("id"), F.lit("cancel").alias("name"), text.alias("arguments")))
    gold = F.concat(F.lit('{"order_id": "o", "count": '), k, F.lit("}"))
    # generators read each text once
    c = T.table(spark, d, "lineitem").select("l_returnflag", kind.alias("kind"), gold.alias("gold"), F.inline(C.parse_calls(call)))
    c = c.select("l_returnflag", "kind", "args", "parse_error", F.explode(F.array(C.parse_args(F.col("gold")))).alias("wanted"))
    c = c.select("l_returnflag", "kind", "args", "parse_error", F.explode(F.array(F.struct(C.canonical_args(F.col("args")).alias("canon"), C.canonical_args(F.col("wanted")).alias("gold")))).alias("t")).select("*", "t.*")
    return c.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count_if("parse_error").alias("parse_errors"), F.count_if(F.col("canon") == F.col("gold")).alias("equal_to_gold"),
        F.count_if(F.size(C.item_list(F.col("args")["item_ids"])) == 2).alias("lists"), F.count_if(F.size("args") == 0).alias("empty"),
        F.count_distinct(F.when(F.col("kind").isin(0, 1, 3), F.col("canon"))).alias("keys"))
