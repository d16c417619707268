"""Work and task sizes that follow the rows: settlement by buckets, log files, shuffles, texts read once."""

import glob
import random

from pyspark.sql import functions as F

from tracemill.functions import calls as C
from tracemill.operators import store as SO
from tracemill.session import sized
from tracemill.sources import runs as R
from tracemill.sources import tables as T
from tracemill.streaming import monitors as M
from tracemill.streaming import sinks as S


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_settlement_is_the_same_in_any_number_of_buckets(spark):
    rnd = random.Random(5)
    rows = sorted({(rnd.randrange(40) - 1, rnd.randrange(4), rnd.randrange(0, 95)) for _ in range(150)}, key=lambda r: r[2])
    rows = [(None if g < 0 else 2 ** 60 + g, s, h, (h * 7 + s) % 5 == 0) for g, s, h in rows]
    want = set()
    for g in {r[0] for r in rows}:
        slots, bad, last, told = set(), False, 0, None
        for _, s, h, f in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])):
            if slots and h - last > 10:
                told = told or (len(slots), "partial")
            if told is None and s not in slots:
                slots, bad, last = slots | {s}, bad or f, h
                told = (4, "dropped" if bad else "kept") if len(slots) == 4 else None
        told = told or ((len(slots), "partial") if last + 10 < max(r[2] for r in rows) else None)
        want |= {(g, *told)} if told else set()
    for buckets, cuts in ((1, [100]), (3, [40, 100])):
        df = spark.createDataFrame(rows, "g long, slot int, h int, failed boolean").withColumn("at", (F.lit(1_700_000_000) + F.col("h") * 3600).cast("timestamp"))
        slices = [df.where((F.col("h") >= a) & (F.col("h") < b)) for a, b in zip([0, *cuts], cuts)]
        out = S.replayed(slices, lambda s: M.settled_once(s, "g", "slot", "at", F.col("failed"), 4, 600, 6000, "0 seconds", buckets), "append", "settled").collect()
        assert len(out) == len(want) and {(r.g, r.landed, r.verdict) for r in out} == want, (buckets, cuts)


def test_log_has_no_file_for_every_span(spark, tmp_path):
    path = str(tmp_path / "log")
    log = S.append_new_rows(path, ["step"], F.col("step"))
    log(spark.range(300).select(F.col("id").alias("step")), 0)
    log(spark.range(200, 400).select(F.col("id").alias("step")), 1)
    assert sorted(r.step for r in spark.read.parquet(path).collect()) == list(range(400))
    assert len(glob.glob(f"{path}/**/*.parquet", recursive=True)) <= 16


def test_item_shuffles_follow_the_rows(spark, sf, monkeypatch):
    assert sized(spark.range(10), 1_000_000, "id").rdd.getNumPartitions() == 4
    small = {tuple(r) for r in SO.decoy_orders(T.order_items(spark, sf), ["delivered", "pending"]).collect()}
    early = sorted(tuple(r) for r in SO.earlier_twins(T.order_items(spark, sf)).collect())
    monkeypatch.setattr(T, "item_rows", lambda spark, d: 3_000_000)
    it = T.order_items(spark, sf)
    assert it.rdd.getNumPartitions() == 12
    spread = SO.decoy_orders(it, ["delivered", "pending"], 3_000_000)
    assert spread.rdd.getNumPartitions() == 12 and {tuple(r) for r in spread.collect()} == small
    assert sorted(tuple(r) for r in SO.earlier_twins(it, 3_000_000).collect()) == early
    asked = SO.conflict_requests(it, T.variants(spark, sf))
    assert plan(asked).count("LeftSemi") == 0


def test_decoys_of_one_user_and_nulls(spark):
    rows = [(1, "p", "delivered", 10), (1, "p", "delivered", 10), (1, "p", "pending", 11), (1, "p", "pending", 12), (1, "q", "delivered", 13),
            (None, "p", "delivered", 14), (None, "p", "pending", 15), (2, "p", "processed", 16), (2, "p", "pending", 17)]
    df = spark.createDataFrame(rows, "user_id long, product string, status string, order_id long")
    for n in (None, 1_000_000):
        assert sorted(tuple(r) for r in SO.decoy_orders(df, ["delivered", "pending"], n).collect()) == [(10, "p", "delivered", 2), (17, "p", "pending", 1)]


def test_lists_of_plain_texts_are_cut_like_parsed_ones(spark):
    lists = ['["a"]', '["a","b c",""]', '[""]', '[]', '[1,"a"]', '["a",null]', '["a\\",\\"b"]', '["\\u0001x","y"]', '["é","[","]",","]', '["a"],["b"]', '["a","b"', '[["a"],"b"]',
             "[" + ",".join('"7"' for _ in range(20_000)) + "]"]
    df = spark.createDataFrame([(i, C.MARK + x) for i, x in enumerate(lists)] + [(90, '["a"]'), (91, None)], "i int, x string")
    rows = df.select("i", C.item_list(F.col("x")).alias("a"), C._parsed_list(F.col("x")).alias("b"), F.col("x").rlike(C.PLAIN_TEXTS).alias("plain")).collect()
    assert all(r.a == r.b for r in rows), [(r.i, r.a, r.b) for r in rows if r.a != r.b]
    assert [r.i for r in rows if r.plain] == [0, 1, 2, 8, 12]


def test_digests_and_documents_are_read_once(spark):
    df = spark.createDataFrame([(["a", "b"], '{"order_id": "1", "items": [{"item_id": "2"}]}')], "items array<string>, doc string")
    assert plan(df.select(SO.state_digest(F.col("items")).alias("m"))).count("md5(") == 1
    flat = R.flat_orders(df, "doc")
    assert "from_json" not in plan(flat["order_items"]).lower().replace("jsontostructs", "from_json")
    assert [tuple(r) for r in flat["order_items"].select("order_id", "item_id").collect()] == [("1", "2")]
