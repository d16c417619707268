"""How episodes end, as a fold whose steps can be composed.

A run of consecutive moves (an agent turn, a batch of tool results, a customer reply) is summed up in a ``Segment``: what it
would do to whatever came before it. Segments of neighbouring runs compose, and composing is associative, so a long
episode is split over tasks, and a stream may bring its moves in any order and batch. A segment's size does not depend on the
number of its moves.

The first cause wins. At one move the move's own cause comes first, then a natural end, the step limit, the error limit.
Limits are looked at after tool results, customer replies and agent turns without calls. A customer who stops and yet asks for
something is asked on, ``overrides`` times; one who closes twice in a row has ended the conversation."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 4096                # moves of an episode that one task folds
# Causes that come without a message of their own, so no step is counted for them.
UNCOUNTED = ("no_progress_timeout", "env_exception", "customer_api_error")


class Limits(NamedTuple):
    steps: int = 200
    errors: int = 10
    overrides: int = 2
    opening: int = 1      # steps before the first move


class Segment(NamedTuple):
    lo: int                             # moves lo to hi - 1
    hi: int
    cause: list | None = None           # [place, cause] of the first move that ends the episode by itself
    stop: int | None = None             # first stop that holds
    soft: tuple = ()                    # first stops that can be overridden, one more than can be
    late: int | None = None             # first check at which the step limit is reached
    errors: tuple = ()                  # [place, failed calls] of the first moves with failed calls
    first: list | None = None           # [place, closing] of the first customer reply
    last: bool | None = None            # the last customer reply closes
    twice: int | None = None            # first reply that closes after one that closes


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def single(at: int, cause: str | None, check: bool, errors: int, reply: bool, closing: bool, stop: int, limits: Limits) -> Segment:
    """One move. ``stop``: 0 none, 1 one that holds, 2 one that can be overridden."""
    return Segment(at, at + 1, [at, cause] if cause else None, at if stop == 1 else None, (at,) if stop == 2 else (),
                   at if check and limits.opening + at + 1 >= limits.steps else None, ([at, errors],) if errors else (),
                   [at, closing] if reply else None, closing if reply else None)


def composed(a: Segment, b: Segment, limits: Limits) -> Segment:
    """``a``, then ``b``, which begins where a ends."""
    twice = _least(a.twice, b.twice)
    if a.last and b.first and b.first[1]:
        twice = _least(twice, b.first[0])
    return Segment(a.lo, b.hi, a.cause or b.cause, _least(a.stop, b.stop), (*a.soft, *b.soft)[:limits.overrides + 1], _least(a.late, b.late),
                   (*a.errors, *b.errors)[:limits.errors], a.first or b.first, a.last if b.last is None else b.last, twice)


def ending(s: Segment, limits: Limits) -> tuple[str, int] | None:
    """Cause and steps of an episode whose first moves are ``s``; None while it goes on."""
    found = [(s.cause[0], 0, s.cause[1])] if s.cause else []
    natural = _least(s.stop, s.twice)
    if len(s.soft) > limits.overrides:
        natural = _least(natural, s.soft[limits.overrides])
    if natural is not None:
        found.append((natural, 1, "natural"))
    if s.late is not None:
        found.append((s.late, 2, "max_turns"))
    n = 0
    for at, errors in s.errors:
        n += errors
        if n >= limits.errors:
            found.append((at, 3, "too_many_errors"))
            break
    if not found:
        return None
    at, _, cause = min(found)
    return cause, limits.opening + at + (cause not in UNCOUNTED)


def added(segments: list[Segment], more: list[Segment], limits: Limits) -> list[Segment]:
    """Sorted segments with gaps between them, and some more of them: neighbours are composed. A segment that covers moves
    already known must be a single one; it is left out."""
    out: list[Segment] = []
    for s in sorted([*segments, *more], key=lambda x: (x.lo, -x.hi)):
        if out and s.lo < out[-1].hi:
            if s.hi - s.lo > 1:
                raise ValueError("segments overlap")
            continue
        if out and s.lo == out[-1].hi:
            out[-1] = composed(out[-1], s, limits)
        else:
            out.append(s)
    return out


def dumped(segments: list[Segment]) -> str:
    return json.dumps(segments, separators=(",", ":"))


def loaded(text: str) -> list[Segment]:
    return [Segment(*s) for s in json.loads(text)]


MOVE = ("cause", "check", "errors", "reply", "closing", "stop")


def moves(df: DataFrame, episode: str, index: str, role: Column, cause: dict[str, Column], has_calls: Column, errors: Column, closing: Column,
          done: Column, premature: Column, at: str | None = None) -> DataFrame:
    """The columns of a move: roles are agent, tool and customer (any other only ends the episode, through ``cause``);
    ``cause`` maps an ending to its condition, the first that holds counts. ``at``: the move's time, for streams."""
    own = F
    for name, holds in cause.items():
        own = own.when(F.coalesce(holds, F.lit(False)), F.lit(name))
    own = own.otherwise(F.lit(None).cast("string")) if cause else F.lit(None).cast("string")
    reply = role == "customer"

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))
    check = flag((role == "tool") | reply | ((role == "agent") & ~flag(has_calls)))
    stop = F.when(flag(reply & done), F.when(flag(premature), 2).otherwise(1)).otherwise(0)
    return df.select(F.col(episode), F.col(index).cast("bigint").alias("index"), own.alias("cause"), check.alias("check"),
                     F.when(role == "tool", F.coalesce(errors, F.lit(0))).otherwise(0).cast("bigint").alias("errors"), flag(reply).alias("reply"), flag(reply & closing).alias("closing"), stop.alias("stop"),
                     *([F.col(at).cast("timestamp").alias("at")] if at else []))


def _folded(limits: Limits):
    """Rows (episode, run, lo, segments or a move) in order: one row for each (episode, run)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush(out):
            out.append((*key, held[0].lo, dumped(held)))
        for batch in batches:
            out = []
            for episode, part, text, index, *move in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (episode, part) != key:
                    if held:
                        flush(out)
                    key, held = (episode, part), []
                new = loaded(text) if text is not None else [single(index, *move, limits)]
                held = added(held[-1:], new, limits) if len(held) < 2 else [*held[:-1], *added(held[-1:], new, limits)]
            if out:
                yield _rows(out, batch)
        if held:
            out = []
            flush(out)
            yield _rows(out, batch)
    return run


def _rows(out: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
    a, b, c, d = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, like.schema.field(0).type), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())], ["episode", "run", "lo", "segments"])


def endings(found: DataFrame, episode: str, limits: Limits = Limits(), run: int = RUN) -> DataFrame:
    """(episode, termination, steps) of ``moves``, numbered from 0 without gaps; ``open`` while nothing ends it. Runs of
    ``run`` moves are folded apart and their segments then composed, so no task sees all moves of a long episode. A move that
    comes twice counts once; moves behind a gap wait for it."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = found.schema[episode].dataType.simpleString()
    out = f"episode {kind}, run long, lo long, segments string"
    each = found.select(F.col(episode).alias("episode"), F.expr(f"index div {run}").alias("run"), F.lit(None).cast("string").alias("segments"), "index", *MOVE)
    runs = each.repartition(parts, "episode", "run").sortWithinPartitions("episode", "run", "index").mapInArrow(_folded(limits), out)
    whole = runs.select("episode", F.lit(0).cast("bigint").alias("run"), "segments", "lo", *[F.lit(None).alias(c) for c in MOVE])
    whole = whole.repartition(parts, "episode").sortWithinPartitions("episode", "lo").mapInArrow(_folded(limits), out)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = []
            for text in batch.column(1).to_pylist():
                s = loaded(text)[0]
                ends.append((ending(s, limits) if s.lo == 0 else None) or ("open", limits.opening + (s.hi if s.lo == 0 else 0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e[0] for e in ends], pa.string()), pa.array([e[1] for e in ends], pa.int64())], [episode, "termination", "steps"])
    return whole.select("episode", "segments").mapInArrow(judged, f"`{episode}` {kind}, termination string, steps long")
