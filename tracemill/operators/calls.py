"""Call and message operators for records stored as one row per call or message.

Order-dependent questions are answered by aggregates where possible (first write against first
authentication, repeats), and by skew-safe windows where a neighbour or a running count is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import text as X
from tracemill.operators import skew


def auth_before_first_write(calls: DataFrame, keys: list[str], order: list[str], is_auth: Column, is_write: Column) -> DataFrame:
    """True/false for episodes that wrote, null for the others: the earliest positions decide."""
    at = F.struct(*order)
    first = calls.groupBy(*keys).agg(F.min(F.when(is_auth, at)).alias("a"), F.min(F.when(is_write, at)).alias("w"))
    return first.select(*keys, F.when(F.col("w").isNotNull(), F.coalesce(F.col("a") < F.col("w"), F.lit(False))).alias("auth_first"))


def repeated_calls(calls: DataFrame, keys: list[str], call_key: list[str]) -> DataFrame:
    """Per episode, calls that repeat an earlier identical call."""
    per = calls.groupBy(*keys, *call_key).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(F.sum("n").alias("calls"), F.sum(F.col("n") - 1).alias("repeated"))


def write_match(done: DataFrame, gold: DataFrame, episode: str, task: str, key: list[str]) -> DataFrame:
    """Multiset match of successful writes and gold writes on ``key``. ``done`` has one row per write,
    ``gold`` one row per gold write of a task. Per episode: matched, total, wrong, unrequested, whether a
    write hit an untouched target, and whether a gold key is missing."""
    d = done.groupBy(episode, task, *key).agg(F.count(F.lit(1)).alias("d"))
    g = gold.groupBy(task, *key).agg(F.count(F.lit(1)).alias("g"))
    tot = g.groupBy(task).agg(F.sum("g").alias("gold_total"), F.count(F.lit(1)).alias("gold_keys"))
    j = d.join(g, [task, *key], "left").groupBy(episode, task).agg(
        F.coalesce(F.sum(F.when(F.col("g").isNotNull(), F.least("d", "g"))), F.lit(0)).cast("bigint").alias("matched"), F.sum("d").alias("done"),
        F.sum(F.greatest(F.col("d") - F.coalesce("g", F.lit(0)), F.lit(0))).alias("unrequested"),
        F.bool_or(F.col("g").isNull()).alias("off_target"), F.count("g").alias("keys_done"))
    out = j.join(tot, task, "left")
    zero = F.lit(0).cast("bigint")
    return out.select(episode, task, "matched", F.coalesce("gold_total", zero).alias("total"), (F.col("done") - F.col("matched")).alias("wrong"),
                      "unrequested", "off_target", (F.col("keys_done") < F.coalesce("gold_keys", zero)).alias("missing"))


def failure_class(matched: DataFrame, success: Column, natural: Column) -> Column:
    return (F.when(success, F.lit(None).cast("string")).when(~natural, F.lit("runaway")).when(F.col("off_target"), F.lit("wrong_target"))
            .when(F.col("missing"), F.lit("missed_write")).when((F.col("wrong") > 0) | (F.col("matched") < F.col("total")), F.lit("wrong_args"))
            .otherwise(F.lit("other")))


def pair_results(turns: DataFrame, episode: str, index: str, is_agent: Column, is_tool: Column, **tuning: int) -> DataFrame:
    """Give every tool message the agent turn it answers and its place j in the unbroken run of tool
    messages after that turn; messages outside such a run get no row. Input index is gapless."""
    step = F.floor(F.col(index) / F.lit(65_536))
    t = turns.withColumn("_a", is_agent.cast("int")).withColumn("_t", is_tool.cast("int"))
    r = skew.running(t, [episode], [F.col(index)], step, {
        "block": F.col("_a").cast("bigint"), "_tools": F.col("_t").cast("bigint"),
        "_others": (1 - F.col("_a") - F.col("_t")).cast("bigint")}, **tuning)
    # inside a block the run is unbroken as long as no other message came since the block's agent turn
    start = r.where("_a = 1").select(episode, "block", F.col(index).alias("agent_idx"), F.col("_tools").alias("_t0"), F.col("_others").alias("_o0"))
    j = r.where("_t = 1").join(start, [episode, "block"]).where("_others = _o0")
    return j.select(*turns.columns, "block", "agent_idx", (F.col("_tools") - F.col("_t0") - 1).alias("j"))


def closing_twice(messages: DataFrame, episode: str, order: list[str], chunk: Column, closing: Column, **tuning: int) -> DataFrame:
    """The first customer message that closes right after another closing one, per episode."""
    n = skew.position(messages.withColumn("_c", closing), [episode], [F.col(c) for c in order], chunk, "_n", **tuning)
    w = skew.beside(n, [episode], "_n", [F.col("_n")], 1, 0, lambda s: {"_p": F.lag("_c").over(s)})
    return w.where(F.col("_c") & F.coalesce("_p", F.lit(False))).groupBy(episode).agg(
        F.min(F.struct(*order)).alias("at")).select(episode, *[F.col("at")[c].alias(c) for c in order])


def message_before(turns: DataFrame, episode: str, index: str, is_user: Column, text: str, reach: int = 3) -> DataFrame:
    """For every row, the last customer text among the ``reach`` rows before it."""
    def cols(s):
        near = s.rowsBetween(-reach, -1)
        return {"user_before": F.last(F.when(is_user, F.col(text)), ignorenulls=True).over(near)}
    return skew.beside(turns, [episode], index, [F.col(index)], reach, 0, cols)


def opening(turns: DataFrame, episode: str, index: str, is_user: Column, text: str) -> DataFrame:
    return turns.where(is_user).groupBy(episode).agg(F.min_by(text, index).alias("opening"))


def communicated(messages: DataFrame, infos: DataFrame, episode: str, text: str, **tuning: int) -> DataFrame:
    """Per episode: were all its infos (an array column, with the episode's message count as ``n``) said
    by the agent. Each message is checked against the short list where it lies."""
    m = skew.attach(messages.select(episode, text), infos, [episode], "n", [text], **tuning)
    said = m.select(episode, F.posexplode(F.transform("infos", lambda i: X.said(F.col(text), i))).alias("k", "said"))
    per = said.groupBy(episode, "k").agg(F.bool_or("said").alias("said")).groupBy(episode).agg(F.bool_and("said").alias("all_said"))
    return infos.select(episode, F.size("infos").alias("n_infos")).join(per, episode, "left").select(
        episode, F.coalesce("all_said", F.col("n_infos") == 0).alias("communicated"))


def termination_fold(steps: DataFrame, episode: str, order: list[Column], chunk: Column, error: Column, natural: Column,
                     max_steps: int, max_errors: int, **tuning: int) -> DataFrame:
    """How each episode ended: the first of natural end, step cap, error cap; open if none came."""
    r = skew.running(steps, [episode], order, chunk, {"_steps": F.lit(1).cast("bigint"), "_errors": error.cast("bigint")}, **tuning)
    cause = (F.when(natural, "natural").when(F.col("_steps") >= max_steps, "max_turns").when(F.col("_errors") >= max_errors, "too_many_errors"))
    hit = r.withColumn("_cause", cause)
    return hit.groupBy(episode).agg(
        F.min(F.when(F.col("_cause").isNotNull(), F.struct("_steps", "_cause"))).alias("end"), F.count(F.lit(1)).alias("messages")).select(
        episode, F.coalesce("end._cause", F.lit("open")).alias("termination"), F.coalesce("end._steps", "messages").alias("steps"))


def price(messages: DataFrame, prices: DataFrame, model: str, tokens_in: str, tokens_out: str, reported: str,
          default_in: int = 8000, default_out: int = 1000) -> DataFrame:
    """Cost per message: token counts at list price for priced models (a conservative estimate when the
    usage is missing), the reported figure for the others."""
    j = messages.join(prices, model, "left")
    known = F.col(tokens_in).isNotNull() & F.col(tokens_out).isNotNull()
    pin = F.when(known, F.col(tokens_in)).otherwise(default_in)
    pout = F.when(known, F.col(tokens_out)).otherwise(default_out)
    return j.withColumn("usd", F.when(F.col("price_in").isNotNull(), (pin * F.col("price_in") + pout * F.col("price_out")) / 1e6)
                        .otherwise(F.coalesce(F.col(reported), F.lit(0.0)))).drop("price_in", "price_out")
