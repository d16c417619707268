"""Monitoring streams: spend, settlement, posteriors, endings.

Counts and sums use built-in streaming aggregates, which combine before the shuffle, so a hot key is one
small row per task. Custom state is kept only where order within a key matters, on rows cut down to the
few columns the rule needs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracemill.functions import episode as E
from tracemill.operators import endings as N


def ledger_totals(lines: DataFrame, keys: list[str], budget: float) -> DataFrame:
    """Running spend and whether it reached the budget."""
    g = lines.groupBy(*keys) if keys else lines.groupBy()
    return g.agg(F.count(F.lit(1)).alias("lines"), F.sum("usd").alias("spent")).withColumn("stop", F.col("spent") >= budget)


def watchdog(sims: DataFrame, keys: list[str], ceiling: float, judge_factor: float = 1.45, per_episode: float = 0.0,
             max_per_episode: float = 0.0376, min_episodes: int = 100, max_hours: float = 3.0) -> DataFrame:
    """Spend and runaway rules per run over simulations counted once by id; the first rule that holds is
    the alert. Input: id, usd, at."""
    once = sims.dropDuplicates(keys + ["id"])
    a = once.groupBy(*keys).agg(F.count(F.lit(1)).alias("episodes"), F.sum("usd").alias("usd"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    est = F.col("usd") * judge_factor + F.col("episodes") * per_episode
    per = F.col("usd") / F.col("episodes")
    hours = (F.unix_micros(F.col("last_at").cast("timestamp")) - F.unix_micros(F.col("first_at").cast("timestamp"))) / 3.6e9
    alert = (F.when(est > ceiling, "ceiling").when((F.col("episodes") >= min_episodes) & (per > max_per_episode), "per_episode")
             .when(hours > max_hours, "hours"))
    return a.withColumn("estimated", est).withColumn("alert", alert)


def stale_alerts(progress: DataFrame, key: str, stale_minutes: float) -> DataFrame:
    """A row for a run that reported nothing for so long while the stream is alive (processing time)."""
    import pandas as pd
    kind = progress.schema[key].dataType.simpleString()

    def watch(k, batches: Iterator, state: GroupState):
        if state.hasTimedOut:
            n = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "episodes": [n], "alert": ["no progress"]})
            return
        n = state.get[0] if state.exists else 0
        for pdf in batches:
            n += len(pdf)
        state.update((n,))
        state.setTimeoutDuration(int(stale_minutes * 60_000))
    return progress.select(key).groupBy(key).applyInPandasWithState(
        watch, f"{key} {kind}, episodes bigint, alert string", "n bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def settled_groups(episodes: DataFrame, size: int) -> DataFrame:
    """Group progress in update mode: landed rollouts, infrastructure failures, and the verdict once the
    last rollout is in. Groups still open when the stream ends are the partial ones."""
    a = episodes.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("landed"), F.bool_or(E.needs_reroll(F.col("termination"))).alias("failed"))
    return a.withColumn("verdict", F.when(F.col("landed") < size, "partial").when(F.col("failed"), "dropped").otherwise("kept"))


def settle_with_timeout(episodes: DataFrame, size: int, wait_ms: int) -> DataFrame:
    """One row per group: when its last rollout lands, or short after a wait with no new rollout. State is
    two numbers a group. A rollout after settlement reopens a group, which shows as a second, short row."""
    import pandas as pd
    kind = episodes.schema["group_id"].dataType.simpleString()

    def settle(k, batches: Iterator, state: GroupState):
        def row(n, failed):
            v = "kept" if n >= size and not failed else "dropped"
            return pd.DataFrame({"group_id": [k[0]], "landed": [n], "verdict": [v]})
        if state.hasTimedOut:
            n, failed = state.get
            state.remove()
            yield row(n, failed)
            return
        n, failed = state.get if state.exists else (0, False)
        for pdf in batches:
            n, failed = n + len(pdf), bool(failed or pdf["failed"].any())
        if n >= size:
            if state.exists:
                state.remove()
            yield row(n, failed)
        else:
            state.update((n, failed))
            state.setTimeoutDuration(wait_ms)
    slim = episodes.select("group_id", E.needs_reroll(F.col("termination")).alias("failed"))
    return slim.groupBy("group_id").applyInPandasWithState(
        settle, f"group_id {kind}, landed bigint, verdict string", "n bigint, failed boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def batch_counters(episodes: DataFrame, keys: list[str]) -> DataFrame:
    """Endings, entropy proxy and spend so far per batch."""
    return episodes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if(E.trains(F.col("termination"))).alias("trainable"), F.sum("neg_logprob").alias("neg_logprob"),
        F.sum("tokens").alias("tokens"), F.sum("usd").alias("usd")).withColumn("entropy_proxy", F.try_divide("neg_logprob", "tokens"))


def posterior_stream(episodes: DataFrame, a0: float, b0: float, retire_n: int, retire_p: float) -> DataFrame:
    """Beta posterior per task as episodes land, with the retirement rule."""
    won = E.eval_reward(F.col("reward"), F.col("termination"))
    s = episodes.where(E.trains(F.col("termination"))).groupBy("task_id").agg(F.sum(won).alias("wins"), F.count(F.lit(1)).alias("obs"))
    a, b = F.lit(a0) + F.col("wins"), F.lit(b0) + F.col("obs") - F.col("wins")
    return s.select("task_id", "wins", "obs", a.alias("a"), b.alias("b"), ((F.col("obs") >= retire_n) & (a / (a + b) > retire_p)).alias("retired"))


def family_levels(episodes: DataFrame, start: int = 1, min_obs: int = 16, at: float = 0.85, top: int = 3) -> DataFrame:
    """Level of each family as batches land: one promotion per micro-batch at most, judged on that
    micro-batch's trainable episodes at the current level. Episodes are summed per (family, level) in
    pandas chunks; state is one number a family."""
    import pandas as pd

    def step(k, batches: Iterator, state: GroupState):
        level = state.get[0] if state.exists else start
        n = wins = 0
        for pdf in batches:
            here = pdf[pdf["level"] == level]
            n, wins = n + len(here), wins + int(here["reward"].sum())
        if n >= min_obs and wins / n >= at and level < top:
            level += 1
        state.update((level,))
        yield pd.DataFrame({"family": [k[0]], "level": [level], "obs": [n]})
    return episodes.select("family", "level", "reward").groupBy("family").applyInPandasWithState(
        step, "family string, level int, obs bigint", "level int", "update", GroupStateTimeout.NoTimeout)


def ema_sink(path: str, alpha: float = 0.5):
    """foreachBatch function: a batch is one step; the exponential mean of each class's share of failures
    moves only when there are failures. The previous step's small table is read from its own folder, so
    a replayed batch gives the same result."""
    def write(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        per = df.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
        total = F.coalesce(per.agg(F.sum("n")).scalar(), F.lit(0))
        share = per.select("class", (F.col("n") / total).alias("share"))
        if epoch == 0:
            new = share.select("class", (F.lit(alpha) * F.col("share")).alias("ema"))
        else:
            old = spark.read.parquet(f"{path}/epoch={epoch - 1}")
            moved = (1 - alpha) * F.coalesce("ema", F.lit(0.0)) + alpha * F.coalesce("share", F.lit(0.0))
            new = old.join(share, "class", "full").select("class", F.when(total > 0, moved).otherwise(F.col("ema")).alias("ema"))
        new.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return write


def closing_stream(messages: DataFrame, key: str, index: str, closing: Column) -> DataFrame:
    """The message at which a customer closed twice in a row, once per conversation. Rows are cut to
    (index, flag); a micro-batch of a conversation is put in order before the flag of the last message
    is carried on."""
    import pandas as pd
    kk, ik = (messages.schema[c].dataType.simpleString() for c in (key, index))

    def step(k, batches: Iterator, state: GroupState):
        prev, done = state.get if state.exists else (False, False)
        pdf = pd.concat(list(batches)).sort_values(index)
        hit = None
        for i, c in zip(pdf[index], pdf["closing"]):
            if not done and c and prev:
                hit, done = i, True
            prev = bool(c)
        state.update((prev, done))
        if hit is not None:
            yield pd.DataFrame({key: [k[0]], index: [hit]})
    slim = messages.select(key, index, closing.alias("closing"))
    return slim.groupBy(key).applyInPandasWithState(step, f"{key} {kk}, {index} {ik}", "prev boolean, done boolean", "append", GroupStateTimeout.NoTimeout)


def ending_stream(steps: DataFrame, key: str, order: list[str], error: Column, natural: Column, max_steps: int, max_errors: int) -> DataFrame:
    """How an episode ends as its messages arrive: first of natural end, step cap, error cap."""
    import pandas as pd
    kk = steps.schema[key].dataType.simpleString()

    def step(k, batches: Iterator, state: GroupState):
        n, errors, done = state.get if state.exists else (0, 0, False)
        pdf = pd.concat(list(batches)).sort_values(order)
        out = None
        if not done:
            for e, nat in zip(pdf["error"], pdf["natural"]):
                n, errors = n + 1, errors + int(e)
                cause = "natural" if nat else "max_turns" if n >= max_steps else "too_many_errors" if errors >= max_errors else None
                if cause:
                    out, done = cause, True
                    break
        state.update((n, errors, done))
        if out:
            yield pd.DataFrame({key: [k[0]], "termination": [out], "steps": [n]})
    slim = steps.select(key, *order, error.cast("int").alias("error"), natural.alias("natural"))
    return slim.groupBy(key).applyInPandasWithState(step, f"{key} {kk}, termination string, steps bigint", "n bigint, errors bigint, done boolean", "append", GroupStateTimeout.NoTimeout)


def endings_stream(moves: DataFrame, episode: str, limits: N.Limits, delay: str, keep_minutes: float) -> DataFrame:
    """Cause and steps of each episode as its moves arrive, in any order and any batches; input as from ``endings.moves`` with
    ``at``. State is the composed segments of what has come (one, once no gap is left). An ending is given out once, when all moves
    before it are there. When the watermark is ``keep_minutes`` past an episode's last move its state goes; if nothing had ended it,
    it is given out as ``open``. ``delay`` bounds how late a move may come."""
    import pandas as pd
    kind = moves.schema[episode].dataType.simpleString()
    keep = int(keep_minutes * 60_000_000)

    def row(k, cause, steps):
        return pd.DataFrame({episode: [k[0]], "termination": [cause], "steps": [steps]})

    def step(k, batches: Iterator, state: GroupState):
        done, last, text = state.get if state.exists else (False, 0, "[]")
        segments = N.loaded(text)
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield row(k, "open", limits.opening + (segments[0].hi if segments and segments[0].lo == 0 else 0))
            return
        for pdf in batches:
            last = max(last, int(pdf["us"].max()))
            if not done:
                rows = zip(*[pdf[c].tolist() for c in ("index", *N.MOVE)], strict=True)
                segments = N.added(segments, [N.single(i, cause or None, *rest, limits) for i, cause, *rest in rows], limits)
        end = N.ending(segments[0], limits) if segments and segments[0].lo == 0 else None
        state.update((done or end is not None, last, "[]" if done or end else N.dumped(segments)))
        state.setTimeoutTimestamp(max((last + keep) // 1000, state.getCurrentWatermarkMs()) + 1)
        if end and not done:
            yield row(k, *end)
    slim = moves.withColumns({"cause": F.coalesce("cause", F.lit("")), "us": F.unix_micros("at")}).withWatermark("at", delay)
    return slim.groupBy(episode).applyInPandasWithState(
        step, f"`{episode}` {kind}, termination string, steps bigint", "done boolean, last bigint, segments string", "append", GroupStateTimeout.EventTimeTimeout)


def stale_gaps(progress: DataFrame, key: str, at: str, stale_minutes: float, delay: str) -> DataFrame:
    """(key, last_at): a row for every time a run reported nothing for so long, by event time: given out when a later report
    shows the gap, or when the watermark passes the last report by that much; the run's state goes with it. Reports of a batch may
    come in any order; they are kept as spans without a long gap."""
    import pandas as pd
    kind = progress.schema[key].dataType.simpleString()
    wait = int(stale_minutes * 60_000_000)

    def watch(k, batches: Iterator, state: GroupState):
        if state.hasTimedOut:
            last = state.get[1]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "us": [last]})
            return
        spans = [list(state.get)] if state.exists else []
        for pdf in batches:
            merged: list[list[int]] = []
            for a, b in sorted([*spans, *([t, t] for t in pdf["us"].tolist())]):
                if merged and a - merged[-1][1] <= wait:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            spans = merged
        ends = [b for _, b in spans]
        due = ends[-1] // 1000 + wait // 1000 + 1
        if due <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
        else:
            state.update(tuple(spans[-1]))
            state.setTimeoutTimestamp(due)
            ends.pop()
        if ends:
            yield pd.DataFrame({key: [k[0]] * len(ends), "us": ends})
    time = F.col(at).cast("timestamp")
    slim = progress.where(time.isNotNull()).select(key, time.alias(at), F.unix_micros(time).alias("us")).withWatermark(at, delay)
    out = slim.groupBy(key).applyInPandasWithState(watch, f"`{key}` {kind}, us bigint", "first bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(key, F.timestamp_micros("us").alias("last_at"))


def settled_once(episodes: DataFrame, group: str, slot: str, at: str, failed: Column, size: int, wait_minutes: float, keep_minutes: float, delay: str,
                 buckets: int = 1024) -> DataFrame:
    """(group, landed, verdict), once a group: ``kept`` or ``dropped`` when its last rollout lands, ``partial`` when none lands for
    ``wait_minutes`` of event time. A slot counts once. A rollout that lands later finds the group settled and changes nothing;
    that mark, and with it all state, goes ``keep_minutes`` afterwards. Groups are numbers, texts or times (null is a group).

    Python is called for a bucket of groups, not for each group: its state is one table of the bucket's groups, and rollouts and
    timers are worked off as columns. A checkpoint holds for its number of ``buckets``."""
    import pandas as pd
    kind = episodes.schema[group].dataType.simpleString()
    wait, keep = int(wait_minutes * 60_000_000), int(keep_minutes * 60_000_000)

    def firsts(parts):
        """A slot's first rollout is enough: at most one row a group and slot stays."""
        rows = pd.concat(parts, ignore_index=True).sort_values(["us", "slot", "failed"], kind="stable")
        return rows.drop_duplicates(["key", "slot"])

    def settle(k, batches: Iterator, state: GroupState):
        now = state.getCurrentWatermarkMs()
        held = _unpacked(state.get[0]) if state.exists else pd.DataFrame({c: pd.Series(dtype=t) for c, t in _SETTLING.items()})
        came = pd.DataFrame({"key": []})
        if not state.hasTimedOut:
            parts, n = [], 0
            for pdf in batches:
                parts, n = [*parts, pdf[["key", "us", "slot", "failed"]]], n + len(pdf)
                if n > 200_000:
                    parts, n = [firsts(parts)], 0
            came = firsts(parts)
        named = pd.Index(held["key"]).append(pd.Index(came["key"], dtype=object)).unique()
        blank = np.zeros(len(named) - len(held))
        slots, bad, last, due, settled = (np.concatenate([held[c].to_numpy(), blank.astype(t)]) for c, t in _SETTLING.items() if c != "key")
        new = np.arange(len(named)) >= len(held)
        verdict, landed = np.full(len(named), "", dtype=object), np.zeros(len(named), dtype=np.int64)
        touched, gone = np.zeros(len(named), dtype=bool), np.zeros(len(named), dtype=bool)
        if len(came):
            at_row = named.get_indexer(came["key"])
            turn = pd.Series(at_row).groupby(at_row).cumcount().to_numpy()
            us, bit, fails = came["us"].to_numpy(), np.left_shift(np.int64(1), came["slot"].to_numpy().astype(np.int64)), came["failed"].to_numpy().astype(bool)
            touched[at_row] = True
            for r in range(int(turn.max()) + 1):                       # a group has at most one row in a round
                pick = turn == r
                g, t, b, f = at_row[pick], us[pick], bit[pick], fails[pick]
                open_ = ~settled[g]
                late = open_ & (slots[g] != 0) & (t - last[g] > wait)
                more = open_ & ~late & (slots[g] & b == 0)
                x = g[late]
                verdict[x], landed[x], settled[x] = "partial", np.bitwise_count(slots[x]), True
                x = g[more]
                last[x] = np.where(slots[x] == 0, np.maximum(t[more], 0), np.maximum(last[x], t[more]))
                slots[x], bad[x] = slots[x] | b[more], bad[x] | f[more]
                x = x[np.bitwise_count(slots[x]) >= size]
                verdict[x], landed[x], settled[x] = np.where(bad[x], "dropped", "kept"), size, True
        over = ~touched & ~new & (due < now)
        gone |= over & settled
        x = over & ~settled
        verdict[x], landed[x], settled[x] = "partial", np.bitwise_count(slots[x]), True
        moved = touched | x
        due[moved] = np.maximum((last[moved] + wait + np.where(settled[moved], keep, 0)) // 1000, now) + 1
        stay = ~gone
        if stay.any():
            state.update((_packed(pd.DataFrame({"key": named.to_numpy(), "slots": slots, "bad": bad, "last": last, "due": due, "settled": settled})[stay]),))
            state.setTimeoutTimestamp(int(due[stay].min()))
        else:
            state.remove()
        out = verdict != ""
        if out.any():
            yield pd.DataFrame({"key": named.to_numpy()[out], "landed": landed[out], "verdict": verdict[out]})
    time = F.col(at).cast("timestamp")
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    slim = episodes.where(time.isNotNull()).select(F.pmod(F.xxhash64(group), F.lit(buckets)).alias("bucket"), key.alias("key"), F.col(slot).cast("int").alias("slot"), time.alias(at),
                                                   F.unix_micros(time).alias("us"), F.coalesce(failed, F.lit(False)).alias("failed")).withWatermark(at, delay)
    out = slim.groupBy("bucket").applyInPandasWithState(settle, "key string, landed bigint, verdict string", "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.when(F.col("key") != "", F.substr("key", F.lit(2))).cast(kind).alias(group), "landed", "verdict")


_SETTLING = {"key": object, "slots": np.int64, "bad": bool, "last": np.int64, "due": np.int64, "settled": bool}


def _packed(held) -> bytes:
    """A table of groups as the bytes of an Arrow file."""
    import pyarrow as pa
    table = pa.Table.from_pandas(held, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(held):
    import pyarrow as pa
    return pa.ipc.open_file(pa.BufferReader(bytes(held))).read_all().to_pandas()
