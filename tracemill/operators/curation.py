"""Dataset curation: leakage by write signature, entity overlap, dedupe, validation order, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text as X


def sharing_tasks(signatures: DataFrame, held: DataFrame, key: list[str], task: str = "task_id") -> DataFrame:
    """Tasks that make a write some held-out task also makes."""
    return signatures.join(held.select(*key).distinct(), key, "left_semi").select(task).distinct()


def leaks(signatures: DataFrame, key: list[str], parts: list[str], task: str = "task_id") -> DataFrame:
    """Per task, whether it makes a write that some task of each guarded part makes (in_<part>). Input
    rows carry the part of their task. Guarded signatures are folded to one row each before the join."""
    guarded = signatures.where(F.col("part").isin(parts)).groupBy(*key).agg(
        *[F.bool_or(F.col("part") == p).alias(f"in_{p}") for p in parts])
    return signatures.join(guarded, key).groupBy(task).agg(*[F.bool_or(f"in_{p}").alias(f"in_{p}") for p in parts])


def unique_signature_tasks(signatures: DataFrame, key: list[str], task: str = "task_id") -> DataFrame:
    """Tasks none of whose write signatures any other task makes. A signature with one owner is kept as
    (owner); a task qualifies when all its signatures are of that kind. Hot signatures collapse in the
    first aggregate, so nothing is joined back on them."""
    own = signatures.select(task, *key).distinct()
    per_sig = own.groupBy(*key).agg(F.count(F.lit(1)).alias("owners"), F.min(task).alias(task))
    alone = per_sig.where("owners = 1").groupBy(task).agg(F.count(F.lit(1)).alias("alone"))
    total = own.groupBy(task).agg(F.count(F.lit(1)).alias("total"))
    return total.join(alone, task).where("alone = total").select(task)


def first_of_each(df: DataFrame, structure: Column, order: str, earlier: DataFrame | None = None) -> DataFrame:
    """The first row (smallest ``order``) of each structural key, leaving out keys already in an earlier
    set (a column ``key``). Keys are digests, so the shuffle carries no texts."""
    keyed = df.select(order, F.sha2(structure, 256).alias("key"))
    first = keyed.groupBy("key").agg(F.min(order).alias(order))
    if earlier is not None:
        first = first.join(earlier.select("key").distinct(), "key", "left_anti")
    return first


def first_failure(checks: dict[str, Column]) -> Column:
    """Name of the first failing check in order, null when all pass. Later checks are not evaluated."""
    out = F
    for name, failed in checks.items():
        out = out.when(F.coalesce(failed, F.lit(False)), F.lit(name))
    return out.otherwise(F.lit(None).cast("string"))


def clean_texts(df: DataFrame, text: str, drop: dict[str, str], replace: dict[str, tuple[str, str, str]], suffix: str) -> DataFrame:
    """Drop texts holding a phrase, replace phrases, add a suffix. ``drop``: reason to phrase;
    ``replace``: reason to (phrase, new phrase, reason). Dropped rows keep their reason."""
    reason = first_failure({r: F.col(text).contains(p) for r, p in drop.items()})
    out = F.col(text)
    changed = F.lit(None).cast("string")
    for name, (old, new) in replace.items():
        changed = F.when(F.col(text).contains(old), F.lit(name)).otherwise(changed)
        out = F.replace(out, F.lit(old), F.lit(new))
    return df.withColumn("dropped", reason).withColumn("changed", F.when(reason.isNull(), changed)).withColumn(
        text, F.when(reason.isNull(), F.concat(out, F.lit(suffix))))


def describe_ids(texts: DataFrame, key: str, body: str, pattern: str, phrases: DataFrame) -> DataFrame:
    """Replace the ids a text mentions by their description where one exists (column ``phrase``, null when
    not unique); other ids stay. Adds how many were described and kept. ``phrases``: id, phrase."""
    found = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)))).alias("id"))
    named = found.join(phrases, "id", "left")
    # a text's own mentions, longest first so an id never matches inside a longer one
    pairs = named.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(
        F.length("id").alias("n"), F.col("id").alias("needle"), F.col("phrase").alias("text"))), asc=False).alias("pairs"))
    j = texts.join(pairs, key, "left")
    have = F.coalesce(F.col("pairs"), F.array().cast("array<struct<n:int,needle:string,text:string>>"))
    return j.withColumn(body, X.tidy_described(X.replace_all(F.col(body), have))).withColumn(
        "described", F.size(F.filter(have, lambda p: p["text"].isNotNull()))).withColumn(
        "kept", F.size(F.filter(have, lambda p: p["text"].isNull()))).drop("pairs")


def split_check(split: DataFrame) -> DataFrame:
    """One row: ids, distinct ids, and ids that sit in more than one part."""
    per = split.groupBy("task_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("part").alias("parts"))
    return per.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("parts") > 1).alias("in_two_parts"),
                   F.count_if(F.col("rows") > F.col("parts")).alias("repeated"))


def require_disjoint(split: DataFrame) -> DataFrame:
    """The split itself; the job fails when an id is repeated or sits in two parts."""
    bad = split_check(split).select((F.col("in_two_parts") + F.col("repeated")).alias("bad")).scalar()
    return split.where(F.assert_true(bad == 0, F.lit("train and val share tasks or ids repeat")).isNull())
