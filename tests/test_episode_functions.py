import gzip
import json

import pytest
from pyspark.sql import functions as F

import fixtures as X
from tracemill.functions import calls as C
from tracemill.functions import episode as E
from tracemill.sources import episodes as S


@pytest.fixture(scope="module")
def eps(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("eps")
    for k, r in X.RECORDS.items():
        with gzip.open(d / f"{k}.json.gz", "wt") as f:
            json.dump(r, f, separators=(",", ":"))
    (d / ".tmp-torn.json.gz").write_bytes(b"junk")
    return S.read_episodes(spark, str(d))


@pytest.fixture(scope="module")
def derived(spark, eps):
    gold = spark.createDataFrame(X.gold_rows(), "episode_id string, g array<struct<name:string,arguments:string>>")
    gold = gold.select("episode_id", F.transform("g", lambda a: F.struct(a["name"].alias("name"), C.parse_args(a["arguments"]).alias("args"))).alias("gold"))
    d = eps.join(gold, "episode_id", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<struct<name:string,args:map<string,string>>>")))
    d = d.withColumn("calls", E.calls(F.col("turns"))).withColumn("done", E.successful_writes(F.col("calls")))
    d = d.withColumn("gw", E.gold_writes(F.col("gold"))).withColumn("pg", E.write_progress(F.col("done"), F.col("gw")))
    d = d.withColumn("checks", E.pair_checks(F.col("turns")))
    d = d.select("episode_id", "pg", "checks", E.unrequested_writes(F.col("done"), F.col("gw")).alias("unreq"),
                 E.rejected_writes(F.col("calls")).alias("rej"), E.repeated_calls(F.col("calls")).alias("rep"),
                 E.graded_credit(F.col("done"), F.col("gw")).alias("graded"),
                 E.failure_class(F.col("reward"), F.col("termination"), F.col("done"), F.col("gw"), F.col("pg")).alias("cls"),
                 E.auth_before_first_write(F.col("calls")).alias("auth"),
                 E.sequences(F.col("turns"), F.col("checks")).alias("seqs"),
                 E.first_divergence(F.col("turns"), F.col("checks")).alias("div"))
    return {r.episode_id: r for r in d.collect()}


def test_scan_skips_torn_files(eps):
    assert eps.count() == len(X.RECORDS)


@pytest.mark.parametrize("eid,unreq,rej,rep,graded,cls", [
    ("uw", 1, 1, 1, 0.0, "wrong_target"), ("gp", 0, 0, 0, 0.5, "missed_write"), ("gq", 0, 0, 0, 0.0, "wrong_args"),
    ("gr", 0, 0, 0, 0.5, "wrong_args"), ("length", 0, 0, 0, 1.0, "runaway")])
def test_write_metrics(derived, eid, unreq, rej, rep, graded, cls):
    r = derived[eid]
    assert (r.unreq, r.rej, r.rep, r.cls) == (unreq, rej, rep, cls)
    assert r.graded == pytest.approx(graded)


def test_progress(derived):
    assert tuple(derived["gp"].pg) == (1, 2, 0)
    assert tuple(derived["gq"].pg) == (0, 1, 1)
    assert derived["rp"].rep == 2
    assert derived["uw"].auth is False and derived["clean"].auth is None


def test_assembly(derived):
    c, d = derived["clean"], derived["dirty"]
    assert all(x.prefix_ok and x.mask_ok for x in c.checks) and len(c.seqs) == 1
    assert [t for t, m in zip(c.seqs[0].token_ids, c.seqs[0].loss_mask) if m] == [10, 11, 12]
    assert c.seqs[0].logprobs == [None, None, None, -0.5, -0.5, None, -0.5]
    assert not d.checks[0].prefix_ok and not d.checks[0].mask_ok and len(d.seqs) == 2
    assert [t for s in d.seqs for t, m in zip(s.token_ids, s.loss_mask) if m] == [10, 11, 12]
    assert d.div.diverges_at == 1 and d.div.turn_pair == 0 and c.div is None


def test_gate(spark, eps):
    g = S.gate_report(eps.where("episode_id in ('clean','dirty')")).collect()[0]
    assert g.single_sequence_rate == 0.5 and g.verdict == "FAIL" and g.compute_saving_x > 1
    assert S.gate_report(eps.where("false")).collect()[0].verdict == "NO_DATA"


def test_quarantine(spark, tmp_path):
    bad = {"short": X.episode("short", [X.agent(out=[1, 2], lps=[-0.1])]), "nope": X.episode("nope", [], termination="nope"),
           "v2": X.episode("v2", [], schema_version=2), "fine": X.episode("fine", [])}
    for k, r in bad.items():
        with gzip.open(tmp_path / f"{k}.json.gz", "wt") as f:
            json.dump(r, f, separators=(",", ":"))
    from tracemill.sources.schema import split_faulty
    ok, faulty = split_faulty(S.read_episodes(spark, str(tmp_path)))
    assert [r.episode_id for r in ok.collect()] == ["fine"]
    assert {r.episode_id: r.fault for r in faulty.collect()} == {"short": "logprob_length", "nope": "termination", "v2": "schema_version"}


def test_training_reward(spark):
    pg = F.struct(F.lit(0).alias("matched"), F.lit(0).alias("total"), F.lit(0).alias("wrong"))

    def r(success, reps, unreq, **kw):
        return E.training_reward(F.lit(success), F.lit(0), F.lit(0), F.lit(reps), F.lit(unreq), pg, F.lit(0.0), **kw)
    row = spark.range(1).select(r(1, 0, 0).alias("a"), r(0, 0, 0).alias("b"), r(0, 0, 1, unrequested_penalty=0.5).alias("c"),
                                r(1, 2, 0, repeat_penalty=0.05).alias("d"), r(1, 8, 0, repeat_penalty=0.05).alias("e"),
                                r(0, 2, 0, repeat_penalty=0.05).alias("f")).collect()[0]
    assert list(row) == pytest.approx([1.0, 0.0, -0.5, 0.9, 0.8, -0.1])


def test_roll_matches_integer_arithmetic(spark):
    import hashlib

    from tracemill.functions import hashing as H
    ids = [f"tb_{i:04d}" for i in range(50)]
    got = {r.id: (r.m, r.even) for r in spark.createDataFrame([(i,) for i in ids], "id string").select(
        "id", H.sha_mod_1000(F.concat(F.lit("vague:"), "id")).alias("m"), H.sha_is_even(F.col("id")).alias("even")).collect()}
    for i in ids:
        assert got[i] == (int(hashlib.sha256(f"vague:{i}".encode()).hexdigest(), 16) % 1000,
                          int(hashlib.sha256(i.encode()).hexdigest(), 16) % 2 == 0)


def test_rolls_of_a_key_in_one_number(spark):
    from tracemill.functions import hashing as H
    salts = ["a", "bc", "", "é", "mind", "x:"]
    df = spark.createDataFrame([("tb_1",), ("",), (None,), ("日本",), ("tb_1",)], "k string")
    packed = df.withColumn("r", H.remainders(F.col("k"), salts))
    got = packed.select("k", *[H.rolled(F.col("r"), i, 0.37).alias(f"n{i}") for i in range(6)], *[H.roll(F.col("k"), s, 0.37).alias(f"o{i}") for i, s in enumerate(salts)],
                        *[(F.shiftright("r", 10 * i).bitwiseAND(F.lit(1023)) == H.sha_mod_1000(F.concat(F.lit(s + ":"), "k"))).alias(f"e{i}") for i, s in enumerate(salts)]).collect()
    assert len(got) == 5 and all(r[f"n{i}"] == r[f"o{i}"] and r[f"e{i}"] == (None if r.k is None else True) for r in got for i in range(6))


def test_varied_tasks_digest_a_key_once(spark, sf):
    from tracemill.plans import QUERIES
    plan = QUERIES["varied_tasks"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count(" conv(") == 0
