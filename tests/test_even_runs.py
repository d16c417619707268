"""Cuts of heavy groups by quantile sketches, for ids of any distribution, and exact ranks and quantiles on top of them."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.operators import sampling as SA
from tracemill.operators import skew
from tracemill.operators import store as SO


def ids(kind, n=3000):
    r = random.Random(kind)
    if kind == "dense":
        return list(range(n))
    if kind == "sparse":                      # powers of two: a run by id width would hold nearly all
        return sorted({int(2 ** (r.random() * 62)) for _ in range(n)})
    if kind == "clustered":
        return sorted({10 ** 15 + i for i in range(n)} | {-5, 0, 7})
    return sorted({-int(2 ** (r.random() * 60)) for _ in range(n)})


@pytest.mark.parametrize("kind", ["dense", "sparse", "clustered", "negative"])
def test_runs_of_equal_size(spark, kind):
    v = ids(kind)
    df = spark.createDataFrame([("hot", i) for i in v] + [("cold", i) for i in v[:1]], "k string, i long")
    cut = skew.with_chunk(df, ["k"], skew.evenly(df, "i"), min_rows=1)
    got = defaultdict(list)
    for r in cut.collect():
        got[r.k, r._chunk].append(r.i)
    hot = {c: x for (k, c), x in got.items() if k == "hot"}
    assert len(hot) > 900 and max(map(len, hot.values())) <= 3 * len(v) / len(hot)
    ends = [(min(hot[c]), max(hot[c])) for c in sorted(hot)]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))       # runs follow the order
    assert [k for k in got if k[0] == "cold"] == [("cold", None)]
    p = skew.position(df, ["k"], [F.col("i")], skew.evenly(df, "i"), "n", min_rows=1)
    assert {(r.k, r.i): r.n for r in p.collect()} == {("hot", i): n + 1 for n, i in enumerate(v)} | {("cold", v[0]): 1}


def test_nulls_ties_times_and_texts(spark):
    rows = [("a", None, None, None)] * 3 + [("a", 5, "tie", f"2024-01-01 00:00:{i:02d}") for i in range(40)] + [("a", i, f"t{i:04d}", f"2023-01-01 00:{i % 60:02d}:00") for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, s string, t string").withColumn("t", F.col("t").cast("timestamp")).withColumn("u", F.monotonically_increasing_id())
    for name in ("i", "s", "t"):
        chunk = skew.evenly(df, name)
        r = skew.position(df, ["k"], [F.col(name), F.col("u")], chunk, "n", min_rows=1).collect()
        assert sorted(x.n for x in r) == list(range(1, 244))
        by = sorted(r, key=lambda x: x.n)
        keys = [(x[name] is not None, x[name], x.u) for x in by]
        assert all(a[:1] < b[:1] or (a[0] == b[0] and (not a[0] or a[1:] <= b[1:])) for a, b in zip(keys, keys[1:]))
    empty = df.where("false")
    assert skew.position(empty, ["k"], [F.col("i")], skew.evenly(empty, "i"), "n").collect() == []


def test_no_heavy_group_needs_no_cut(spark):
    df = spark.range(50).select((F.col("id") % 7).alias("k"), F.col("id").alias("i"))
    assert {r._chunk for r in skew.with_chunk(df, ["k"], skew.evenly(df, "i")).collect()} == {None}


def test_slots_and_plan_with_sparse_ids(spark):
    v = ids("sparse", 900)
    tasks = spark.createDataFrame([(1, i) for i in v] + [(2, i) for i in v[:3]], "batch int, task long")
    want = {(1, i): f"b0001-g{n:03d}-{i}" for n, i in enumerate(v)} | {(2, i): f"b0002-g{n:03d}-{i}" for n, i in enumerate(v[:3])}
    got = SA.rollout_slots(tasks, "batch", "task", 2, 5, {"a": 1.0}, {"b": 1.0}, min_rows=1).select("batch", "task", "group_id").distinct().collect()
    assert {(r.batch, r.task): r.group_id for r in got} == want
    landed = spark.createDataFrame([(i,) for i in v[:10] for _ in range(4)] + [(v[11],)], "task long")
    plan = SA.resume_plan(tasks.where("batch = 1").select("task"), landed, "task", 4, [0, 100, 500], min_rows=1).collect()
    assert {r.task: r.chunk for r in plan} == {i: (2 if n >= 500 else 1 if n >= 100 else 0) for n, i in enumerate(v) if n >= 10}


def test_earlier_twins_of_sparse_orders(spark):
    v = ids("sparse", 60)
    items = spark.createDataFrame([(1, "p", "pending", i) for i in v for _ in range(2)], "user_id int, product string, status string, order_id long")
    assert {r.order_id: r.decoys for r in SO.earlier_twins(items).collect()} == {i: n for n, i in enumerate(v) if n}


@pytest.mark.parametrize("buckets", [2, 20, 1000])
def test_exact_quantiles_of_any_distribution(spark, buckets):
    r = random.Random(9)
    values = {"ties": [r.choice([1.0, 2.0, 2.5]) for _ in range(500)], "wide": [2 ** (r.random() * 60) for _ in range(501)], "one": [3.25], "same": [7.0] * 40, "signs": [r.gauss(0, 1) for _ in range(800)]}
    df = spark.createDataFrame([(k, x) for k, v in values.items() for x in v] + [("ties", None)] * 5, "k string, v double")
    qs = {"lo": 0.0, "m": 0.5, "q": 0.99, "hi": 1.0}
    for row in skew.exact_quantiles(df, ["k"], "v", qs, buckets=buckets).collect():
        for name, q in qs.items():
            assert row[name] == pytest.approx(np.quantile(values[row.k], q)), (row.k, name)
