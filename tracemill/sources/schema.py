"""Record schemas and their invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import episode as E

CORRUPT = "_corrupt_record"  # the text of a record that cannot be read
SCHEMA_VERSION = 1  # fixed value: the only record version readers accept

TURN = ("struct<_k:string,role:string,text:string,finish_reason:string,content:string,tool_name:string,"
        "tool_call:struct<name:string,arguments:string>,"
        "tool_calls:array<struct<id:string,name:string,arguments:string>>,"
        "prompt_token_ids:array<int>,token_ids:array<int>,logprobs:array<double>>")

EXTRA = ("struct<steps:int,db_ok:boolean,communicate_ok:boolean,persona:string,customer:string,"
         "empty_messages:int,tool_errors:int,customer_retries:int,customer_cost:double,"
         "mean_neg_logprob:double,n_gen_tokens:int,customer_variant:string,closed_by_backstop:boolean,"
         "stop_overrides:int,abort:string>")

EPISODE = (
    f"episode_id string, batch_id int, policy_version string, task_id string, group_id string, trial_index int,"
    f"seed bigint, turns array<{TURN}>, reward int, termination string, db_hash_before string,"
    f"db_hash_after string, wall_clock_s double, recorded_at timestamp, schema_version int, extra {EXTRA}")

SIMULATION = ("struct<id:string,task_id:string,reward_info:struct<reward:double,db_check:struct<db_reward:double>>,"
              "termination_reason:string,duration:double,user_cost:double,"
              "messages:array<struct<role:string,tool_calls:array<struct<name:string>>,"
              "usage:struct<prompt_tokens:bigint,completion_tokens:bigint>>>>")

ACTION = "struct<action_id:string,requestor:string,name:string,arguments:string,info:string,compare_args:string>"

TASK = (
    f"id string, description struct<purpose:string,relevant_policies:string,notes:string>,"
    f"user_scenario struct<persona:string,instructions:string>, initial_state string,"
    f"evaluation_criteria struct<actions:array<{ACTION}>,communicate_info:array<string>,"
    f"nl_assertions:array<string>,reward_basis:array<string>>")

LEDGER = ("at string, usd double, what string")


def normalise_turns(turns: Column) -> Column:
    """Turns as stored, with the tag renamed and older single-call turns read as a one-call list."""
    def one(t: Column) -> Column:
        single = F.when(t["tool_call"].isNotNull(), F.array(F.struct(
            F.lit(None).cast("string").alias("id"), t["tool_call"]["name"].alias("name"),
            t["tool_call"]["arguments"].alias("arguments"))))
        listed = F.when(F.size(t["tool_calls"]) > 0, t["tool_calls"])
        return F.struct(t["_k"].alias("kind"), t["role"].alias("role"), t["text"].alias("text"),
                        t["finish_reason"].alias("finish_reason"), t["content"].alias("content"),
                        t["tool_name"].alias("tool_name"), F.coalesce(listed, single).alias("tool_calls"),
                        t["prompt_token_ids"].alias("prompt_token_ids"), t["token_ids"].alias("token_ids"),
                        t["logprobs"].alias("logprobs"))
    return F.transform(turns, one)


def record_fault(version: Column, termination: Column, reward: Column, arrays_match: Column, corrupt: Column | None = None) -> Column:
    """Why a record is rejected, or null. Unreadable text comes first, then a wrong version: nothing else about such a
    record can be trusted."""
    return (F.when(F.lit(False) if corrupt is None else corrupt.isNotNull(), F.lit("unreadable"))
            .when(~version.eqNullSafe(F.lit(SCHEMA_VERSION)), F.lit("schema_version"))
            .when(~F.coalesce(arrays_match, F.lit(False)), F.lit("logprob_length"))
            .when(~F.coalesce(E.known_termination(termination), F.lit(False)), F.lit("termination"))
            .when(~F.coalesce(reward.isin(0, 1), F.lit(False)), F.lit("reward")))


def turn_arrays_match(turns: Column) -> Column:
    return F.forall(E.agent_turns(turns), lambda t: F.size(t["logprobs"]).eqNullSafe(F.size(t["token_ids"])))


def split_faulty(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sound, quarantined) episodes."""
    tagged = df.withColumn("fault", record_fault(F.col("schema_version"), F.col("termination"), F.col("reward"),
                                                 turn_arrays_match(F.col("turns")), F.col(CORRUPT) if CORRUPT in df.columns else None))
    return tagged.where("fault is null").drop("fault"), tagged.where("fault is not null")
