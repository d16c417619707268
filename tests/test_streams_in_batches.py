"""Streams over several batches with a restart before each: gaps, settlement and the append log."""

from pyspark.sql import functions as F

from tracemill.streaming import monitors as M
from tracemill.streaming import sinks as S


def at(df, column="h"):
    return df.withColumn("at", (F.lit(1_700_000_000) + F.col(column) * 3600).cast("timestamp"))


def test_stale_runs_whatever_the_batches(spark):
    hours = {"a": [0, 1, 2, 30, 31, 90], "b": [0, 9, 18, 27, 36, 45, 54, 63, 72, 81, 90, 95], "c": [50], "d": [0, 95]}
    want = sorted((k, h) for k, hs in hours.items() for h, nxt in zip(hs, [*hs[1:], 95]) if nxt - h > 10)
    rows = [(k, h) for k, hs in hours.items() for h in hs]
    for cuts in ([96], [20, 60, 96], [5, 10, 15, 31, 32, 91, 96]):
        df = at(spark.createDataFrame(rows + rows[:3], "k string, h int"))
        slices = [df.where((F.col("h") >= a) & (F.col("h") < b)) for a, b in zip([0, *cuts], cuts)]
        out = S.replayed(slices, lambda s: M.stale_gaps(s, "k", "at", 600, "0 seconds"), "append", "stale").collect()
        assert sorted((r.k, int(r.last_at.timestamp() - 1_700_000_000) // 3600) for r in out) == want, cuts


def test_groups_settle_once_and_late_rollouts_change_nothing(spark):
    rows = [("full", i, i, False) for i in range(4)] + [("bad", i, i, i == 2) for i in range(4)] + [("short", 0, 0, False), ("short", 1, 3, False), ("short", 2, 40, False), ("short", 3, 41, False)]
    rows += [("full", 1, 50, True), ("twice", 0, 0, False), ("twice", 0, 1, False), ("twice", 1, 2, False), ("twice", 2, 3, False), ("open", 0, 95, False), ("last", 0, 99, None)]
    want = sorted([("full", 4, "kept"), ("bad", 4, "dropped"), ("short", 2, "partial"), ("twice", 3, "partial")])
    for cuts in ([100], [2, 60, 100], [1, 2, 3, 30, 45, 80, 100]):
        df = at(spark.createDataFrame(rows, "g string, slot int, h int, failed boolean"))
        slices = [df.where((F.col("h") >= a) & (F.col("h") < b)) for a, b in zip([0, *cuts], cuts)]
        out = S.replayed(slices, lambda s: M.settled_once(s, "g", "slot", "at", F.col("failed"), 4, 600, 6000, "0 seconds"), "append", "settled").collect()
        assert sorted((r.g, r.landed, r.verdict) for r in out) == want, cuts


def test_log_by_spans_reads_its_own_and_replays(spark, tmp_path):
    path = str(tmp_path / "log")
    log = S.append_new_rows(path, ["step", "repeat"], F.floor(F.col("step") / 100))
    def batch(*rows):
        return spark.createDataFrame([(s, r, v) for s, r, v in rows], "step long, repeat int, v string")
    log(batch((1, 0, "a"), (1, 0, "a"), (1, 1, "b"), (None, 0, "n")), 0)
    log(batch((1, 0, "late"), (1, 2, "c"), (250, 0, "d"), (None, 0, "late")), 1)
    log(batch((250, 0, "late"), (999, 0, "e")), 2)
    log(batch((1, 0, "late"), (1, 2, "c"), (250, 0, "d"), (None, 0, "late")), 1)     # replay
    got = sorted(((r.step, r.repeat, r.v, r.span, r.epoch) for r in spark.read.parquet(path).collect()), key=str)
    assert got == sorted([(1, 0, "a", 0, 0), (1, 1, "b", 0, 0), (None, 0, "n", -1, 0), (1, 2, "c", 0, 1), (250, 0, "d", 2, 1), (999, 0, "e", 9, 2)], key=str)
    wide = S.append_new_rows(path, ["step", "repeat"], F.floor(F.col("step") / 100), most_spans=1)
    wide(batch((1, 0, "late"), (999, 0, "late"), (999, 1, "f")), 3)
    assert spark.read.parquet(path).where("epoch = 3").count() == 1
