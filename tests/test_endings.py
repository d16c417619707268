"""The composed fold of endings against a plain loop, in batch and as a stream in any order."""

import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import endings as N
from tracemill.streaming import monitors as M
from tracemill.streaming import sinks as S

CAUSES = ["length", "tool_parse_error", "empty_message", "no_progress_timeout", "env_exception", "customer_api_error"]
SCHEMA = "e string, i long, role string, cause string, calls boolean, errors int, closing boolean, done boolean, premature boolean, index int"


def episode(r, n, calm):
    out = []
    for _ in range(n):
        role = r.choice(["agent", "tool", "customer"])
        cause = r.choice(CAUSES) if r.random() > calm else None
        out.append((role, cause, r.random() < 0.5, r.choice([0, 0, 1, 2]), r.random() < 0.3, r.random() < 0.1, r.random() < 0.7))
    return out


def loop(moves, limits):
    steps, errors, closed, overrides = limits.opening, 0, False, 0
    for role, cause, calls, failed, closing, done, premature in moves:
        if cause:
            return cause, steps + (cause not in N.UNCOUNTED)
        steps += 1
        if role == "tool":
            errors += failed
        if role == "customer":
            if done and premature and overrides < limits.overrides:
                overrides += 1
            elif done:
                return "natural", steps
            if closing and closed:
                return "natural", steps
            closed = closing
        if not (role == "agent" and calls):
            if steps >= limits.steps:
                return "max_turns", steps
            if errors >= limits.errors:
                return "too_many_errors", steps
    return "open", steps


def made(limits, n=250):
    r = random.Random(limits.steps)
    return {f"e{j}": episode(r, r.choice([0, 1, 3, 12, 40]), r.choice([0.9, 0.99, 1.0])) for j in range(n)}


def moves(df):
    c = F.col
    return N.moves(df, "e", "i", c("role"), {x: c("cause") == x for x in CAUSES}, c("calls"), c("errors"), c("closing"), c("done"), c("premature"))


def rows(eps):
    return [(e, i, *m, 5) for e, ms in eps.items() for i, m in enumerate(ms)]


@pytest.mark.parametrize("limits", [N.Limits(14, 4, 1, 1), N.Limits(200, 10, 2, 0), N.Limits(25, 3, 0, 1)])
def test_any_split_of_an_episode_gives_the_same_segment(limits):
    r = random.Random(2)
    for ms in made(limits, 150).values():
        singles = [N.single(i, cause, not (role == "agent" and calls), failed if role == "tool" else 0, role == "customer", role == "customer" and closing,
                            (2 if premature else 1) if role == "customer" and done else 0, limits) for i, (role, cause, calls, failed, closing, done, premature) in enumerate(ms)]
        want = loop(ms, limits)
        for _ in range(4):
            left, segments = singles[:], []
            r.shuffle(left)
            while left:
                k = r.randint(1, len(left))
                segments = N.loaded(N.dumped(N.added(segments, left[:k] + left[:r.randint(0, 1)], limits)))
                left = left[k:]
            got = N.ending(segments[0], limits) if segments else None
            assert (got or ("open", limits.opening + len(ms))) == want
            assert len(segments) <= 1 and all(len(s.errors) <= limits.errors and len(s.soft) <= limits.overrides + 1 for s in segments)


@pytest.mark.parametrize("run", [3, 4096])
def test_batch_endings(spark, run):
    limits = N.Limits(30, 5, 2, 1)
    eps = made(limits)
    df = moves(spark.createDataFrame(rows(eps) + rows(eps)[:50], SCHEMA).repartition(5))
    got = {r.e: (r.termination, r.steps) for r in N.endings(df, "e", limits, run).collect()}
    assert got == {e: loop(ms, limits) for e, ms in eps.items() if ms}
    assert {g[0] for g in got.values()} >= {"natural", "max_turns", "too_many_errors", "open", *CAUSES}


def test_gaps_nulls_and_no_rows(spark):
    limits = N.Limits(200, 10, 2, 1)
    some = [(None, 0, "agent", None, False, 0, False, False, False, 1), (None, 1, "customer", None, None, None, None, True, None, 1), ("gap", 0, "agent", None, None, None, None, None, None, 1),
            ("gap", 2, "customer", None, None, None, None, True, None, 1), ("late", 1, "customer", None, None, None, None, True, None, 1), ("odd", 0, None, None, None, None, None, None, None, 1)]
    got = {r.e: (r.termination, r.steps) for r in N.endings(moves(spark.createDataFrame(some, SCHEMA)), "e", limits).collect()}
    assert got == {None: ("natural", 3), "gap": ("open", 2), "late": ("open", 1), "odd": ("open", 2)}
    assert N.endings(moves(spark.createDataFrame([], SCHEMA)), "e", limits).collect() == []


def test_long_episode(spark):
    limits = N.Limits(10 ** 9, 10 ** 9, 2, 0)
    df = spark.range(60_000).select(F.lit("long").alias("e"), F.col("id").alias("i"), F.lit("customer").alias("role"), F.lit(None).cast("string").alias("cause"), F.lit(False).alias("calls"),
                                    F.lit(0).alias("errors"), (F.col("id") >= 59_990).alias("closing"), F.lit(False).alias("done"), F.lit(False).alias("premature"))
    assert [tuple(r) for r in N.endings(moves(df), "e", limits).collect()] == [("long", "natural", 59_992)]


def timed(df, hours):
    return df.withColumn("at", (F.lit(1_700_000_000) + hours * 3600).cast("timestamp"))


def stream_of(limits, delay, keep):
    def build(s):
        c = F.col
        m = N.moves(s, "e", "i", c("role"), {x: c("cause") == x for x in CAUSES}, c("calls"), c("errors"), c("closing"), c("done"), c("premature"), at="at")
        return M.endings_stream(m, "e", limits, delay, keep)
    return build


def test_stream_endings_in_any_order(spark):
    limits = N.Limits(30, 5, 2, 1)
    eps = made(limits, 120)
    all_rows = rows(eps)
    random.Random(5).shuffle(all_rows)
    slices = [timed(spark.createDataFrame(all_rows[k::4] + all_rows[:20], SCHEMA), F.col("i")) for k in range(4)]
    out = S.replayed(slices, stream_of(limits, "1000 hours", 60), "append", "ends")
    got = [(r.e, r.termination, r.steps) for r in out.collect()]
    assert sorted(got) == sorted((e, *loop(ms, limits)) for e, ms in eps.items() if ms and loop(ms, limits)[0] != "open")


def test_stream_endings_leave_no_state(spark):
    """Batches in order of time: what nothing ended is given out as open, and a key that comes back much later starts anew."""
    limits = N.Limits(30, 5, 2, 1)
    move = ("customer", None, False, 0, False, False, False, 5)
    day = lambda d, *keys: timed(spark.createDataFrame([(k, i, *move) for k, i in keys], SCHEMA), F.lit(24 * d))
    slices = [day(0, ("a", 0), ("a", 1), ("b", 1)), day(5, ("c", 0)), day(10, ("a", 0)), day(20, ("d", 0))]
    out = S.replayed(slices, stream_of(limits, "1 hour", 60 * 24), "append", "gone").collect()
    assert sorted((r.e, r.termination, r.steps) for r in out) == [("a", "open", 2), ("a", "open", 3), ("b", "open", 1), ("c", "open", 2)]
