"""Episode files: scan, store, gate report, sequences and chat messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import episode as E
from tracemill.session import materialise
from tracemill.sources import schema as S

GATE_THRESHOLD = 0.95  # fixed value: share of episodes that must assemble as one sequence


EPISODE_FILES = "*.json.gz"


def read_episodes(spark: SparkSession, *paths: str, recursive: bool = False, pattern: str = EPISODE_FILES) -> DataFrame:
    """Episode records from one or many folders of compact gzipped JSON, one record a line. Hidden
    files (torn writes, summaries) are skipped by the file source; the text of a record that cannot be read is kept in
    ``_corrupt_record``."""
    reader = spark.read.schema(f"{S.EPISODE}, {S.CORRUPT} string").option("pathGlobFilter", pattern).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", S.CORRUPT)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.json(list(paths)).withColumn("source_file", F.input_file_name())
    return df.withColumn("turns", S.normalise_turns(F.col("turns")))


def with_run_and_batch(df: DataFrame) -> DataFrame:
    """run and batch folder names from the file path (…/<run>/records/<batch>/<file>)."""
    return (df.withColumn("run", F.regexp_extract("source_file", r"/([^/]+)/records/", 1))
            .withColumn("batch_dir", F.regexp_extract("source_file", r"/([^/]+)/[^/]+$", 1)))


SPAN, SPAN_BATCHES = "batch_span", 1000  # fixed value: batches that share a folder of the store


def span_of(batch: Column) -> Column:
    """The folder of a batch: it never falls while the number grows. No number, no span."""
    return F.floor(batch.try_cast("bigint") / F.lit(SPAN_BATCHES))


def folders(spark: SparkSession, path: str, column: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}=*")
    return bool(len(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []))


def write_episodes(df: DataFrame, path: str) -> None:
    """Append by batch; rewriting a batch replaces just that batch. A folder holds SPAN_BATCHES batches, in order of batch within
    its files, so there are as many files as the rows need, however many the batches. The commit protocol replaces whole folders:
    the other batches of a folder are read and written again beside the new ones, so a store has one writer at a time. The
    rebalance hint gathers a folder into few files, and splits one that holds most rows over several tasks."""
    spark = df.sparkSession
    if folders(spark, path, "batch_id"):
        raise ValueError(f"{path} has a folder a batch: write its episodes to a new store")
    if folders(spark, path, SPAN):
        df = materialise(df, "episodes-new")      # its batches and its rows have to agree
        store = spark.read.parquet(path)
        df = df.withColumn("batch_id", F.col("batch_id").cast(store.schema["batch_id"].dataType))
        spans = [r[0] for r in df.select(span_of(F.col("batch_id"))).distinct().collect()]     # the folders to be replaced
        touched = F.col(SPAN).isin([x for x in spans if x is not None])
        rest = store.where(touched | F.col(SPAN).isNull() if None in spans else touched).drop(SPAN)
        batches = df.select(F.col("batch_id").alias("again")).distinct()
        rest = rest.join(batches, F.col("batch_id").eqNullSafe(F.col("again")), "left_anti")
        df = df.drop(SPAN).unionByName(rest, allowMissingColumns=True)
    (df.withColumn(SPAN, span_of(F.col("batch_id"))).hint("rebalance", SPAN).sortWithinPartitions(SPAN, "batch_id").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(SPAN).parquet(path))


def keep_through(df: DataFrame, last_batch: int) -> DataFrame:
    """Records up to a checkpoint; in a store of ``write_episodes`` a partition filter leaves out the folders after it."""
    kept = df.where(F.col("batch_id") <= F.lit(last_batch))
    return kept.where(F.col(SPAN) <= span_of(F.lit(last_batch))) if SPAN in df.columns else kept


def gate_report(episodes: DataFrame) -> DataFrame:
    """One row: how often episodes assemble as a single sequence, and the verdict."""
    checked = episodes.select("termination", E.pair_checks(F.col("turns")).alias("checks"),
                              E.token_totals(F.col("turns")).alias("tok"))
    flat = checked.select(
        E.trains(F.col("termination")).cast("int").alias("trainable"), F.size("checks").alias("pairs"),
        F.size(F.filter("checks", lambda c: c["prefix_ok"])).alias("prefix_ok"),
        F.size(F.filter("checks", lambda c: c["mask_ok"])).alias("mask_ok"),
        E.is_single(F.col("checks")).cast("int").alias("single"), "tok.single", "tok.per_turn").toDF(
        "trainable", "pairs", "prefix_ok", "mask_ok", "one", "tok_single", "tok_turn")
    return gate_from_flags(flat)


def gate_from_flags(flat: DataFrame) -> DataFrame:
    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))
    agg = flat.agg(F.count(F.lit(1)).alias("episodes"), total("trainable").alias("trainable"),
                   total("pairs").alias("turn_pairs"), total("prefix_ok").alias("p"), total("mask_ok").alias("m"),
                   total("one").alias("single_sequence_episodes"), total("tok_single").alias("tokens_single_sequence"),
                   total("tok_turn").alias("tokens_per_turn"))
    rate = F.coalesce(F.try_divide("single_sequence_episodes", "episodes"), F.lit(0.0))
    return agg.select(
        "episodes", "trainable", "turn_pairs",
        F.coalesce(F.try_divide("p", "turn_pairs"), F.lit(1.0)).alias("prefix_ok_rate"),
        F.coalesce(F.try_divide("m", "turn_pairs"), F.lit(1.0)).alias("mask_ok_rate"),
        "single_sequence_episodes", rate.alias("single_sequence_rate"), "tokens_single_sequence", "tokens_per_turn",
        F.coalesce(F.try_divide("tokens_per_turn", "tokens_single_sequence"), F.lit(0.0)).alias("compute_saving_x"),
        F.when(F.col("episodes") == 0, F.lit("NO_DATA")).when(rate >= GATE_THRESHOLD, F.lit("PASS"))
        .otherwise(F.lit("FAIL")).alias("verdict"))


def failing_spans(episodes: DataFrame) -> DataFrame:
    """First divergence of every episode that does not assemble as one sequence."""
    c = episodes.withColumn("checks", E.pair_checks(F.col("turns")))
    # A generator evaluates the record once; expanding a struct column would repeat it per field, and a
    # filter on the checks would be pushed below the columns it needs and compute them again.
    d = E.first_divergence(F.col("turns"), F.col("checks"))
    return c.select("episode_id", F.inline(F.filter(F.array(d), lambda x: x.isNotNull())))


def training_sequences(episodes: DataFrame, max_len: int) -> DataFrame:
    """One row a sequence with its training arrays; sequences over max_len are flagged, not lost."""
    c = episodes.withColumn("checks", E.pair_checks(F.col("turns")))
    s = c.select("episode_id", F.posexplode(E.sequences(F.col("turns"), F.col("checks"))).alias("seq_idx", "seq"))
    return s.select("episode_id", "seq_idx", F.size("seq.token_ids").alias("length"),
                    (F.size("seq.token_ids") > max_len).alias("too_long"), "seq.token_ids", "seq.loss_mask",
                    E.training_arrays(F.col("seq")).alias("t")).select("*", "t.*").drop("t")


def chat_messages(turns: Column, system: str, greeting: str) -> Column:
    """The chat transcript of a record: system, greeting, then the turns. A tool message takes the id of
    the call it answers: its place in the run of tool messages after the agent turn."""
    none = F.lit(None).cast("string")
    no_calls = F.lit(None).cast("array<struct<id:string,name:string,arguments:string>>")

    def msg(role, content, call_id=none, tc=no_calls):
        return F.struct(role.alias("role"), content.alias("content"), call_id.alias("tool_call_id"), tc.alias("tool_calls"))

    def turn(t: Column, i: Column) -> Column:
        before = F.slice(turns, F.lit(1), i)
        back = F.coalesce(F.nullif(F.array_position(F.transform(F.reverse(before), lambda x: x["kind"]), "a"), F.lit(0)), F.lit(1)).cast("int")
        owner = F.try_element_at(before, F.size(before) - back + F.lit(1))
        call_id = F.try_element_at(owner["tool_calls"], back)["id"]
        has_calls = F.coalesce(F.size(t["tool_calls"]) > 0, F.lit(False))
        return (F.when(t["kind"] == "a", msg(F.lit("assistant"), F.when((t["text"] != "") | ~has_calls, t["text"]), none,
                                              F.when(has_calls, t["tool_calls"])))
                .when(t["role"] == "tool", msg(F.lit("tool"), t["content"], call_id))
                .when(t["role"] == "user", msg(F.lit("user"), t["content"])))
    head = F.array(msg(F.lit("system"), F.lit(system)), msg(F.lit("assistant"), F.lit(greeting)))
    return F.concat(head, F.filter(F.transform(turns, turn), lambda m: m.isNotNull()))
