"""Columns over one episode record: an episode is one row holding its ``turns`` array, whose length
the rollout guards bound, so everything here is row-local and costs no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions import calls as C

# How an episode can end, and whether that ending trains the policy.
TERMINATIONS = {"natural": True, "no_progress_timeout": True, "max_turns": True, "empty_message": True,
                "tool_parse_error": True, "invalid_tool_args": True, "too_many_errors": True, "length": True,
                "customer_api_error": False, "env_exception": False}
FAILURE_CLASSES = ("runaway", "wrong_target", "missed_write", "wrong_args", "other")

CALL = "struct<turn_idx:int,call_idx:int,name:string,args:map<string,string>,result:string,ok:boolean,rejected:boolean>"


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and use it many times: lambdas are interpreted, so an expression repeated
    inside one would be computed again at every step."""
    return F.element_at(F.transform(F.array(value), use), F.lit(1))


# ------------------------------------------------------------------ record-level rules

def known_termination(t: Column) -> Column:
    return t.isin(*TERMINATIONS)


def trains(t: Column) -> Column:
    return t.isin(*[k for k, v in TERMINATIONS.items() if v])


def needs_reroll(t: Column) -> Column:
    return t.isin(*[k for k, v in TERMINATIONS.items() if not v])


def eval_reward(reward: Column, t: Column) -> Column:
    return F.when(t == "natural", reward).otherwise(F.lit(0))


def state_reward(db_ok: Column, comm_ok: Column, t: Column) -> Column:
    """1 when the episode ended naturally with the right state and everything said."""
    return F.when((t == "natural") & db_ok & comm_ok, F.lit(1)).otherwise(F.lit(0))


# ------------------------------------------------------------------ calls and their results

def agent_turns(turns: Column) -> Column:
    return F.filter(turns, lambda t: t["kind"] == "a")


def calls(turns: Column) -> Column:
    """Every tool call in order with its result: call j of a turn owns the j-th tool message of the
    unbroken run of tool messages right after that turn."""
    def per_turn(t: Column, i: Column) -> Column:
        def per_call(c: Column, j: Column) -> Column:
            # try_element_at is one-based; turn i sits at i+1 and its j-th result at i+2+j
            run = F.slice(turns, i + F.lit(2), j + F.lit(1))
            have = (F.size(run) == j + 1) & F.forall(run, lambda r: F.coalesce(r["role"] == "tool", F.lit(False)))
            result = F.when(have, F.try_element_at(turns, i + j + F.lit(2))["content"])
            bad = F.coalesce(result.startswith(C.ERROR_PREFIX), F.lit(False))
            return F.struct(i.alias("turn_idx"), j.alias("call_idx"), c["name"].alias("name"),
                            C.readable_args(c["arguments"])["args"].alias("args"),
                            result.alias("result"), (have & ~bad).alias("ok"), (have & bad).alias("rejected"))
        return F.transform(F.when(t["kind"] == "a", t["tool_calls"]), per_call)
    return F.flatten(F.filter(F.transform(turns, per_turn), lambda x: x.isNotNull()))


def writes(calls_: Column, read_tools: tuple[str, ...] = C.READ_TOOLS) -> Column:
    return F.filter(calls_, lambda c: C.is_write(c["name"], read_tools))


def successful_writes(calls_: Column, read_tools: tuple[str, ...] = C.READ_TOOLS) -> Column:
    return F.filter(calls_, lambda c: C.is_write(c["name"], read_tools) & c["ok"])


def rejected_writes(calls_: Column, read_tools: tuple[str, ...] = C.READ_TOOLS) -> Column:
    return F.size(F.filter(calls_, lambda c: C.is_write(c["name"], read_tools) & c["rejected"]))


def repeated_calls(calls_: Column) -> Column:
    """Calls identical in name and arguments to an earlier call of the episode."""
    keys = F.transform(F.filter(calls_, lambda c: F.coalesce(c["name"], F.lit("")) != ""),
                       lambda c: C.canonical_key(c["name"], c["args"]))
    return let(keys, lambda k: F.size(k) - F.size(F.array_distinct(k)))


def auth_before_first_write(calls_: Column, read_tools: tuple[str, ...] = C.READ_TOOLS,
                            auth_tools: tuple[str, ...] = C.AUTH_TOOLS) -> Column:
    """Null when the episode never wrote."""
    def positions(keep):
        idx = F.transform(calls_, lambda c, i: F.when(keep(c["name"]), i))
        return F.array_min(F.filter(idx, lambda x: x.isNotNull()))
    auth = positions(lambda n: n.isin(*auth_tools))
    write = positions(lambda n: C.is_write(n, read_tools) & ~n.isin(*auth_tools))
    return F.when(write.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(auth < write, F.lit(False)))


def opening(turns: Column) -> Column:
    """The first customer message."""
    return F.try_element_at(F.filter(turns, lambda t: t["role"] == "user"), F.lit(1))["content"]


def agent_texts(turns: Column) -> Column:
    return F.transform(agent_turns(turns), lambda t: t["text"])


def seen_earlier(turns: Column, needle: Column, before_turn: Column) -> Column:
    """The text occurred in a tool result before the given turn."""
    return F.exists(F.slice(turns, F.lit(1), before_turn),
                    lambda t: F.coalesce((t["role"] == "tool") & t["content"].contains(needle), F.lit(False)))


def message_before(turns: Column, turn: Column, reach: int = 3) -> Column:
    """The last customer message among the few turns before the given one."""
    start = F.greatest(turn - F.lit(reach), F.lit(0))
    near = F.slice(turns, start + F.lit(1), turn - start)
    return F.try_element_at(F.filter(near, lambda t: t["role"] == "user"), F.lit(-1))["content"]


# ------------------------------------------------------------------ writes against gold

def gold_writes(gold: Column, read_tools: tuple[str, ...] = C.READ_TOOLS) -> Column:
    return F.filter(gold, lambda g: ~g["name"].isin(*read_tools))


def _count(keys: Column, key: Column) -> Column:
    return F.size(F.filter(keys, lambda x: x.eqNullSafe(key)))


def _keys(writes_: Column, key) -> Column:
    return F.transform(writes_, lambda c: key(c["name"], c["args"]))


def unrequested_writes(done: Column, gold: Column) -> Column:
    """Successful writes beyond the gold count of their (tool, target)."""
    both = F.struct(_keys(done, C.write_key).alias("d"), _keys(gold, C.write_key).alias("g"))
    return let(both, lambda b: F.aggregate(F.array_distinct(b["d"]), F.lit(0), lambda acc, k: acc + F.greatest(
        _count(b["d"], k) - _count(b["g"], k), F.lit(0))))


def write_progress(done: Column, gold: Column) -> Column:
    """(matched, total, wrong) under multiset matching of canonical keys."""
    both = F.struct(_keys(done, C.canonical_key).alias("d"), _keys(gold, C.canonical_key).alias("g"))
    matched = let(both, lambda b: F.aggregate(F.array_distinct(b["d"]), F.lit(0), lambda acc, k: acc + F.least(
        _count(b["d"], k), _count(b["g"], k))))
    return let(matched, lambda m: F.struct(m.alias("matched"), F.size(gold).alias("total"), (F.size(done) - m).alias("wrong")))


def graded_credit(done: Column, gold: Column) -> Column:
    """Each gold write in order takes its closest unused write on the same tool and target (ties go
    to the earlier write, and a candidate counts even at closeness 0); leftover writes each cost a
    full write. The mask text marks used writes, one character each, so any array length works."""
    start = F.struct(F.repeat(F.lit("0"), F.size(done)).alias("mask"), F.lit(0.0).alias("sum"))

    def step(acc: Column, g: Column) -> Column:
        options = F.filter(F.transform(done, lambda d, i: F.when(
            (F.substring(acc["mask"], i + F.lit(1), F.lit(1)) == "0") & (d["name"] == g["name"])
            & C.match_target(d["args"]).eqNullSafe(C.match_target(g["args"])),
            F.struct(C.closeness(g["args"], d["args"]).alias("c"), (-i).alias("i")))), lambda o: o.isNotNull())
        best = F.array_max(options)
        return F.when(best.isNull(), acc).otherwise(F.struct(
            F.overlay(acc["mask"], F.lit("1"), F.lit(1) - best["i"]).alias("mask"),
            (acc["sum"] + F.coalesce(best["c"], F.lit(0.0))).alias("sum")))

    def finish(acc: Column) -> Column:
        unmatched = F.length(F.replace(acc["mask"], F.lit("1"), F.lit("")))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (acc["sum"] - unmatched) / F.size(gold)))
    return F.when(F.size(gold) == 0, F.lit(0.0)).otherwise(F.aggregate(gold, start, step, finish))


def failure_class(reward: Column, termination: Column, done: Column, gold: Column, progress: Column) -> Column:
    """The first rule that explains a failed episode; null on success."""
    d = F.transform(done, lambda c: C.write_key(c["name"], c["args"]))
    g = F.transform(gold, lambda c: C.write_key(c["name"], c["args"]))
    return (F.when(eval_reward(reward, termination) == 1, F.lit(None).cast("string"))
            .when(termination != "natural", F.lit("runaway"))
            .when(F.size(F.array_except(d, g)) > 0, F.lit("wrong_target"))
            .when(F.size(F.array_except(g, d)) > 0, F.lit("missed_write"))
            .when((progress["wrong"] > 0) | (progress["matched"] < progress["total"]), F.lit("wrong_args"))
            .otherwise(F.lit("other")))


def training_reward(success: Column, rejected: Column, wrong: Column, repeats: Column, unrequested: Column,
                    progress: Column, graded: Column, *, partial_credit: float = 0.0,
                    credit_mode: str = "gated", unrequested_penalty: float = 0.0, mistake_penalty: float = 0.0,
                    mistake_cap: float = 0.2, repeat_penalty: float = 0.0, repeat_cap: float = 0.2) -> Column:
    """Reward seen by the optimiser: a success is 1 minus capped mistakes and repeats; a failure gets
    partial credit (gated by any wrong write, or graded), minus repeats and the unrequested penalty."""
    rep = F.least(F.lit(repeat_cap), F.lit(repeat_penalty) * repeats)
    docked = F.least(F.lit(mistake_cap), F.lit(mistake_penalty) * (rejected + wrong))
    credit = graded if credit_mode == "graded" else F.when(
        (progress["total"] > 0) & (progress["wrong"] == 0), progress["matched"] / progress["total"]).otherwise(F.lit(0.0))
    failed = (F.lit(partial_credit) * credit - rep
              - F.when(unrequested > 0, F.lit(unrequested_penalty)).otherwise(F.lit(0.0)))
    return F.when(success == 1, F.lit(1.0) - docked - rep).otherwise(failed)


# ------------------------------------------------------------------ token arrays

def pair_checks(turns: Column) -> Column:
    """For each adjacent pair of agent turns: does the next prompt start with this prompt, and does
    this output sit right after it."""
    def over(a: Column) -> Column:
        steps = F.when(F.size(a) > 1, F.sequence(F.lit(1), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))

        def check(k: Column) -> Column:
            cur, nxt = F.element_at(a, k), F.element_at(a, k + F.lit(1))
            n, m = F.size(cur["prompt_token_ids"]), F.size(cur["token_ids"])
            prefix = F.slice(nxt["prompt_token_ids"], F.lit(1), n) == cur["prompt_token_ids"]
            span = F.slice(nxt["prompt_token_ids"], n + F.lit(1), m) == cur["token_ids"]
            return let(prefix, lambda p: F.struct((k - 1).alias("idx"), p.alias("prefix_ok"), (p & span).alias("mask_ok")))
        return F.transform(steps, check)
    return let(agent_turns(turns), over)


def is_single(checks: Column) -> Column:
    return F.forall(checks, lambda c: c["mask_ok"])


def token_totals(turns: Column) -> Column:
    """Tokens processed if trained as one sequence, and if trained turn by turn."""
    a = agent_turns(turns)
    last = F.try_element_at(a, F.lit(-1))
    return F.struct(
        F.coalesce(F.size(last["prompt_token_ids"]) + F.size(last["token_ids"]), F.lit(0)).cast("bigint").alias("single"),
        F.aggregate(a, F.lit(0).cast("bigint"),
                    lambda s, t: s + F.size(t["prompt_token_ids"]) + F.size(t["token_ids"])).alias("per_turn"))


def first_divergence(turns: Column, checks: Column, context: int = 8) -> Column:
    """The first failing pair with the tokens around the point where its prompts part."""
    def at_pair(x: Column) -> Column:
        cur, nxt = F.element_at(x["a"], x["bad"]["idx"] + F.lit(1)), F.element_at(x["a"], x["bad"]["idx"] + F.lit(2))
        two = F.struct(cur["prompt_token_ids"].alias("p"), nxt["prompt_token_ids"].alias("q"), F.size(cur["prompt_token_ids"]).alias("n"),
                       F.try_element_at(cur["tool_calls"], F.lit(1))["name"].alias("call"), x["bad"].alias("bad"))
        return let(two, spans)

    def spans(t: Column) -> Column:
        m = F.least(t["n"], F.size(t["q"]))
        differs = F.zip_with(F.slice(t["p"], F.lit(1), m), F.slice(t["q"], F.lit(1), m), lambda x, y: x != y)
        apart = F.nullif(F.array_position(differs, F.lit(True)), F.lit(0)).cast("int") - 1
        return let(F.coalesce(apart, F.when(~t["bad"]["prefix_ok"], t["n"])), lambda at: around(t, at))

    def around(t: Column, at: Column) -> Column:
        # a divergence at position 0 reads like "none" when the window is placed, so it centres on n
        centre = F.when(at > 0, at).otherwise(t["n"])
        lo = F.greatest(centre - F.lit(context), F.lit(0))
        span = centre + F.lit(context) - lo
        return F.struct(t["bad"]["idx"].alias("turn_pair"), t["bad"]["prefix_ok"].alias("prefix_ok"), t["bad"]["mask_ok"].alias("mask_ok"),
                        at.alias("diverges_at"), F.slice(t["p"], lo + F.lit(1), span).alias("expected"),
                        F.slice(t["q"], lo + F.lit(1), span).alias("actual"), t["call"].alias("prior_tool_call"))
    bad = F.try_element_at(F.filter(checks, lambda c: ~c["mask_ok"]), F.lit(1))
    return let(F.struct(bad.alias("bad"), agent_turns(turns).alias("a")), lambda x: F.when(x["bad"].isNotNull(), at_pair(x)))


def sequences(turns: Column, checks: Column) -> Column:
    """Training sequences of an episode: one when every pair is consistent, else one per agent turn.
    logprobs are null outside the generated spans; loss_mask marks those spans."""
    none = F.array().cast("array<double>")

    def gap(n: Column) -> Column:
        return F.array_repeat(F.lit(None).cast("double"), n)

    def sequence_of(tokens: Column, mask: Column, lps: Column) -> Column:
        return F.struct(tokens.alias("token_ids"), mask.alias("loss_mask"), lps.alias("logprobs"))

    def marks(n_gap: Column, n_out: Column) -> Column:
        return F.concat(F.array_repeat(F.lit(False), n_gap), F.array_repeat(F.lit(True), n_out))

    def build(a: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        lps = F.aggregate(a, none, lambda acc, t: F.concat(acc, gap(F.size(t["prompt_token_ids"]) - F.size(acc)), t["logprobs"]))
        mask = F.aggregate(a, F.array().cast("array<boolean>"), lambda acc, t: F.concat(
            acc, marks(F.size(t["prompt_token_ids"]) - F.size(acc), F.size(t["token_ids"]))))
        whole = F.array(sequence_of(F.concat(last["prompt_token_ids"], last["token_ids"]), mask, lps))
        each = F.transform(a, lambda t: sequence_of(
            F.concat(t["prompt_token_ids"], t["token_ids"]),
            marks(F.size(t["prompt_token_ids"]), F.size(t["token_ids"])),
            F.concat(gap(F.size(t["prompt_token_ids"])), t["logprobs"])))
        return F.when(F.size(a) == 0, F.array().cast(SEQUENCES)).when(is_single(checks), whole).otherwise(each)
    return let(agent_turns(turns), build)


SEQUENCES = "array<struct<token_ids:array<int>,loss_mask:array<boolean>,logprobs:array<double>>>"


def training_arrays(seq: Column) -> Column:
    """positions (one before each trained token), targets and behaviour logprobs of a sequence."""
    idx = F.filter(F.transform(seq["loss_mask"], lambda m, i: F.when(m, i)), lambda x: x.isNotNull())
    return F.struct(F.transform(idx, lambda i: i - 1).alias("positions"),
                    F.transform(idx, lambda i: F.element_at(seq["token_ids"], i + F.lit(1))).alias("targets"),
                    F.transform(idx, lambda i: F.element_at(seq["logprobs"], i + F.lit(1))).alias("behavior_lp"))


def neg_logprob_sum(turns: Column) -> Column:
    return F.aggregate(agent_turns(turns), F.lit(0.0), lambda s, t: s - F.aggregate(
        t["logprobs"], F.lit(0.0), lambda x, y: x + y))
