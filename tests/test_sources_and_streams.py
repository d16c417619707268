import gzip
import json
import time

import pytest
from pyspark.sql import functions as F

import fixtures as X
from tracemill.sources import episodes as EP
from tracemill.sources import runs as R
from tracemill.streaming import monitors as M
from tracemill.streaming import sinks as S


def test_results_and_costs(spark, tmp_path):
    run = tmp_path / "run1"
    (run / "simulations").mkdir(parents=True)
    sims = [{"id": "a", "task_id": "t1", "reward_info": {"reward": 1.0, "db_check": {"db_reward": 1.0}}, "termination_reason": "TerminationReason.user_stop", "duration": 3.0,
             "user_cost": 0.5, "messages": [{"role": "assistant", "tool_calls": [{"name": "think"}], "usage": {"prompt_tokens": 10, "completion_tokens": 2}}, {"role": "user"}]},
            {"id": "b", "task_id": "t1", "reward_info": None, "termination_reason": "user_stop", "messages": []}]
    (run / "results.json").write_text(json.dumps({"simulations": sims}))
    for i, c in (("a", 9.0), ("c", None), ("d", 0.25)):
        (run / "simulations" / f"{i}.json").write_text(json.dumps({"id": i, "user_cost": c}))
    got = {r.sim_id: r for r in R.read_results(spark, f"{run}/results.json").collect()}
    assert got["a"].scored and not got["b"].scored and got["a"].ending == "user_stop" and got["a"].prompt_tokens == 10 and got["a"].calls == ["think"] and got["a"].run == "run1"
    assert {r.id: r.usd for r in R.read_costs(spark, str(run)).collect()} == {"a": 0.5, "b": 0.0, "c": 0.0, "d": 0.25}
    e = R.estimated_spend(R.read_costs(spark, str(run)), 1.45, 0.01).collect()[0]
    assert e.estimated_usd == pytest.approx(0.75 * 1.45 + 0.04)


def test_task_profile_and_split_files(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"t1": {"successes": 3, "trials": 8}, "t2": {"successes": 0, "trials": 8}}, indent=1))
    (tmp_path / "s.json").write_text(json.dumps({"train": ["t1"], "val": ["t2"]}))
    (tmp_path / "r.json").write_text(json.dumps({"t1": {"family": "bundle", "writes": 4}}))
    task = {"id": "t1", "description": {"purpose": None}, "user_scenario": {"persona": None, "instructions": {"domain": "retail"}}, "evaluation_criteria": {
        "actions": [{"action_id": "t1_0", "name": "cancel_pending_order", "arguments": {"order_id": "#W1"}}], "communicate_info": ["5"], "reward_basis": ["DB"]}}
    (tmp_path / "t.json").write_text(json.dumps([task, dict(task, id="t2", user_scenario={"persona": None, "instructions": "plain text"})]))
    assert {tuple(r) for r in R.read_profile(spark, f"{tmp_path}/p.json").collect()} == {("t1", 3, 8), ("t2", 0, 8)}
    assert {tuple(r) for r in R.read_split(spark, f"{tmp_path}/s.json").collect()} == {("t1", "train"), ("t2", "val")}
    assert R.read_report(spark, f"{tmp_path}/r.json").collect()[0].writes == 4
    t = R.read_tasks(spark, f"{tmp_path}/t.json")
    ins = {r.task_id: r.i for r in t.select("task_id", F.col("user_scenario.instructions").alias("i")).collect()}
    assert ins["t2"] == "plain text" and json.loads(ins["t1"]) == {"domain": "retail"}
    assert [json.loads(r.arguments) for r in R.gold_actions(t).collect()] == [{"order_id": "#W1"}] * 2


def test_ledger_round_trip(spark, tmp_path):
    p = tmp_path / "ledger"
    R.append_ledger(spark.createDataFrame([("2024-01-01", 0.12345678, "a")], "at string, usd double, what string"), str(p))
    (p / "torn.txt").write_bytes(b'\x00\x00{"at": "x", "usd": 1.5, "what": "b"}\n\n{"at": "x", "us\n{"what": "c"}\n\x00\x00\x00')
    r = R.read_ledger(spark, str(p))
    assert r.agg(F.sum("usd")).collect()[0][0] == pytest.approx(0.123457 + 1.5)
    assert r.where("corrupt").count() == 1 and r.count() == 4
    bad = R.damaged_files(spark, str(p)).collect()
    assert len(bad) == 1 and bad[0].file.endswith("torn.txt")


def test_episode_store(spark, tmp_path):
    df = spark.createDataFrame([(f"e{i}", i % 3, i) for i in range(30)], "episode_id string, batch_id int, v int")
    path = str(tmp_path / "store")
    EP.write_episodes(df, path)
    EP.write_episodes(df.where("batch_id = 1").withColumn("v", F.lit(-1)), path)  # rewriting a batch replaces only it
    got = spark.read.parquet(path)
    assert got.count() == 30 and got.where("v = -1").count() == 10 and EP.keep_through(got, 1).count() == 20


def test_episode_store_files_follow_the_rows(spark, tmp_path):
    df = spark.range(6000).selectExpr("concat('e', id) AS episode_id", "IF(id < 5990, CAST(id % 2500 - 100 AS INT), NULL) AS batch_id", "id AS v")
    path = str(tmp_path / "store")
    EP.write_episodes(df, path)
    assert len(list((tmp_path / "store").rglob("*.parquet"))) < 40          # a file a batch would be 2,501
    EP.write_episodes(df.where("batch_id IN (-3, 7, 1500)").limit(1).unionByName(df.where("batch_id IS NULL").limit(2)).withColumn("v", F.lit(-1)), path)
    got = spark.read.parquet(path)
    first = df.where("batch_id IN (-3, 7, 1500)").limit(1).collect()[0].batch_id
    gone = df.where(f"batch_id = {first}").count()
    assert got.count() == 6000 - 10 - gone + 1 + 2 and got.where("v = -1").count() == 3
    assert got.where(f"batch_id = {first} OR batch_id IS NULL").count() == 3
    for last in (-101, -100, -1, 0, 999, 1000, 2399):
        assert EP.keep_through(got, last).count() == got.where(f"batch_id <= {last}").count()
    assert EP.keep_through(got, 999).where("batch_span > 0").count() == 0


def test_episode_store_other_cases(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 2000, 3)], "episode_id string, batch_id int, v int")
    path = str(tmp_path / "store")
    EP.write_episodes(df, path)
    EP.write_episodes(df.where("false"), path)                               # nothing to write changes nothing
    EP.write_episodes(spark.createDataFrame([("d", 2), ("e", 2)], "episode_id string, batch_id long"), path)    # a column less, another type
    EP.write_episodes(spark.read.parquet(path).where("batch_id = 2000").withColumn("v", F.lit(9)), path)        # read from the store itself
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("episode_id", "batch_id", "v").collect()) == [
        ("a", 1, 1), ("c", 2000, 9), ("d", 2, None), ("e", 2, None)]
    df.write.partitionBy("batch_id").parquet(str(tmp_path / "old"))
    with pytest.raises(ValueError, match="a folder a batch"):
        EP.write_episodes(df, str(tmp_path / "old"))


def test_runs_in_sub_folders(spark, tmp_path):
    for b in ("b0001", "b0002"):
        d = tmp_path / "p4" / "records" / b
        d.mkdir(parents=True)
        with gzip.open(d / "x.json.gz", "wt") as f:
            json.dump(X.RECORDS["clean"], f, separators=(",", ":"))
    got = EP.with_run_and_batch(EP.read_episodes(spark, f"{tmp_path}/p4", recursive=True)).select("run", "batch_dir").collect()
    assert {tuple(r) for r in got} == {("p4", "b0001"), ("p4", "b0002")}


def test_chat_messages(spark, tmp_path):
    turns = [X.agent([X.GET("#W1"), X.GET("#W2")]), X.tool("one"), X.tool("two"), X.agent(text="done"), X.user("bye")]
    with gzip.open(tmp_path / "e.json.gz", "wt") as f:
        json.dump(X.episode("e", turns), f, separators=(",", ":"))
    e = EP.read_episodes(spark, str(tmp_path))
    m = e.select(EP.chat_messages(F.col("turns"), "policy", "Hi").alias("m")).collect()[0].m
    assert [(x.role, x.content, x.tool_call_id) for x in m] == [("system", "policy", None), ("assistant", "Hi", None), ("assistant", None, None), ("tool", "one", "c0"),
                                                                ("tool", "two", "c1"), ("assistant", "done", None), ("user", "bye", None)]
    assert [c.name for c in m[2].tool_calls] == ["get_order_details"] * 2


def test_store_file(spark, tmp_path):
    db = {"products": {"p": {"product_id": "p", "name": "Lamp", "variants": {"i1": {"item_id": "i1", "options": {"size": "S"}, "available": True, "price": 2.0}, "i2": {"item_id": "i2", "options": {"size": "M"}, "available": False, "price": 3.0}}}},
          "users": {"u": {"user_id": "u", "name": {"first_name": "A"}, "address": {"city": "X"}, "payment_methods": {"g": {"id": "g", "source": "gift_card", "balance": 5.0}}}}, "orders": {"#W1": {"order_id": "#W1"}}}
    (tmp_path / "db.json").write_text(json.dumps(db))
    s = R.read_store(spark, f"{tmp_path}/db.json")
    assert {r.item_id: r.options for r in s["variants"].collect()} == {"i1": {"size": "S"}, "i2": {"size": "M"}}
    assert s["payments"].collect()[0].balance == 5.0 and s["orders"].count() == 1


# ------------------------------------------------------------------ streams over several micro-batches

def pieces(df, path, n):
    df.repartition(n).write.parquet(path)
    return path


def test_settlement_over_batches(spark, tmp_path):
    rows = [("t1", "natural")] * 4 + [("t2", "length")] * 4 + [("bad", "customer_api_error")] * 4 + [("short", "natural")] * 2
    src = pieces(spark.createDataFrame(rows, "group_id string, termination string"), str(tmp_path / "in"), 5)
    out = S.latest(S.drain(M.settled_groups(S.table_stream(spark, src, files_per_trigger=1), 4), "update", "t"), ["group_id"])
    assert {r.group_id: r.verdict for r in out.collect()} == {"t1": "kept", "t2": "kept", "bad": "dropped", "short": "partial"}


def test_settlement_flushes_partials(spark, tmp_path):
    rows = [("t1", "natural")] * 4 + [("bad", "customer_api_error")] * 4 + [("short", "natural")] * 2
    src = pieces(spark.createDataFrame(rows, "group_id string, termination string"), str(tmp_path / "in"), 3)
    q = (M.settle_with_timeout(S.table_stream(spark, src, files_per_trigger=1), 4, 6000).writeStream.outputMode("append").format("memory").queryName("settled")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start())
    try:
        for _ in range(40):
            if spark.table("settled").count() >= 3:
                break
            time.sleep(1)
    finally:
        q.stop()
    assert {(r.group_id, r.landed, r.verdict) for r in spark.table("settled").collect()} == {("t1", 4, "kept"), ("bad", 4, "dropped"), ("short", 2, "dropped")}


def test_stale_run_raises_an_alert(spark, tmp_path):
    src = pieces(spark.createDataFrame([("r1", 1), ("r1", 2)], "run string, n int"), str(tmp_path / "in"), 1)
    q = (M.stale_alerts(S.table_stream(spark, src), "run", 1 / 60).writeStream.outputMode("append").format("memory").queryName("stale")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start())
    try:
        for _ in range(30):
            if spark.table("stale").count():
                break
            time.sleep(1)
    finally:
        q.stop()
    assert [tuple(r) for r in spark.table("stale").collect()] == [("r1", 2, "no progress")]


def test_ledger_and_watchdog_count_ids_once(spark, tmp_path):
    rows = [("r", f"s{i % 6}", 1.0, f"2024-01-01 0{i % 6}:00:00") for i in range(12)]
    df = spark.createDataFrame(rows, "run string, id string, usd double, at string").withColumn("at", F.col("at").cast("timestamp"))
    src = pieces(df, str(tmp_path / "in"), 4)
    out = S.latest(S.drain(M.watchdog(S.table_stream(spark, src, files_per_trigger=1), ["run"], ceiling=100, max_hours=4.5), "update", "w"), ["run"]).collect()[0]
    assert out.episodes == 6 and out.alert == "hours"
    tot = S.latest(S.drain(M.ledger_totals(S.table_stream(spark, src, files_per_trigger=1), [], 10.0).withColumn("k", F.lit(1)), "complete", "l"), ["k"]).collect()[0]
    assert tot.lines == 12 and tot.stop


def test_closing_and_ending_state_crosses_batches(spark, tmp_path):
    base = str(tmp_path / "in")
    for b, rows in enumerate([[(1, 0, True)], [(1, 1, True), (2, 0, True)], [(2, 1, False), (2, 2, True)]]):
        spark.createDataFrame(rows, "c int, t int, closing boolean").coalesce(1).write.parquet(f"{base}/p{b}")
        time.sleep(0.05)
    schema = "c int, t int, closing boolean"
    st = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(base)
    got = S.drain(M.closing_stream(st, "c", "t", F.col("closing")), "append", "c").select("c", "t").collect()
    assert [tuple(r) for r in got] == [(1, 1)]
    st = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(base)
    ends = S.drain(M.ending_stream(st, "c", ["t"], F.lit(False), F.lit(False), 2, 9), "append", "e").select("c", "termination", "steps").collect()
    assert {tuple(r) for r in ends} == {(1, "max_turns", 2), (2, "max_turns", 2)}


def test_ema_and_idempotent_log(spark, tmp_path):
    path = str(tmp_path / "ema")
    sink = M.ema_sink(path)
    steps = [["a", "a", "b", "b"], [], ["a"]]
    for e, cls in enumerate(steps):
        sink(spark.createDataFrame([(c,) for c in cls], "class string"), e)
    got = {r["class"]: r.ema for r in spark.read.parquet(f"{path}/epoch=2").collect()}
    assert got == {"a": pytest.approx(0.5 * 0.25 + 0.5), "b": pytest.approx(0.125)}
    log = S.append_new_rows(str(tmp_path / "log"), ["step"])
    for e, rows in enumerate([[1, 2], [2, 3], [2, 3]]):
        log(spark.createDataFrame([(r,) for r in rows], "step int"), e)
    log(spark.createDataFrame([(2,), (3,)], "step int"), 1)  # replay
    assert sorted(r.step for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [1, 2, 3]


def test_family_levels_stream(spark, tmp_path):
    rows = [("x", 1, 1)] * 16 + [("y", 1, 0)] * 16
    src = pieces(spark.createDataFrame(rows, "family string, level int, reward int"), str(tmp_path / "in"), 1)
    out = S.latest(S.drain(M.family_levels(S.table_stream(spark, src)), "update", "f"), ["family"])
    assert {r.family: r.level for r in out.collect()} == {"x": 2, "y": 1}
