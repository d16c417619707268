"""Micro-batch sinks. Every write is keyed by the batch number, so a replayed batch overwrites itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.session import work_folder


def table_stream(spark: SparkSession, path: str, schema=None, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table as a stream. The schema is given or taken from the table's footer; streams never
    infer it."""
    schema = schema if schema is not None else spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def batch_writer(path: str, transform: Callable[[DataFrame, int], DataFrame] | None = None):
    def write(df: DataFrame, epoch: int) -> None:
        out = transform(df, epoch) if transform else df
        out.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return write


def drain(stream: DataFrame, mode: str, purpose: str, transform=None) -> DataFrame:
    """Run a stream over everything available and return what its batches wrote, with their number."""
    spark = stream.sparkSession
    base = work_folder(spark, purpose)
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state")
         .foreachBatch(batch_writer(f"{base}/out", transform)).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")


def latest(written: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of each key of an update-mode result."""
    cols = [c for c in written.columns if c not in keys + ["epoch"]]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*cols), "epoch").alias("s")).select(*keys, "s.*")


def replayed(slices: list[DataFrame], build: Callable[[DataFrame], DataFrame], mode: str, purpose: str, sink=batch_writer) -> DataFrame:
    """What a stream writes when its input comes in several micro-batches: each slice is added to the input's folder and the
    query is started again from its checkpoint, so every slice is one batch (or more, for timers) and a restart."""
    spark = slices[0].sparkSession
    base = work_folder(spark, purpose)
    for i, part in enumerate(slices):
        part.write.parquet(f"{base}/in/slice={i}")
        stream = build(spark.readStream.schema(part.schema).parquet(f"{base}/in/slice=*"))
        (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(sink(f"{base}/out"))
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_new_rows(path: str, keys: list[str], span: Column | None = None, most_spans: int = 10_000):
    """foreachBatch function that appends only rows whose key no earlier batch has written.

    ``span`` is a range of keys as a whole number (say, a thousand steps): a batch is written to its own folder in order of span,
    so a later batch reads only the files and row groups of the spans it has rows of, and there are as many files as the rows need,
    however many the spans. A batch with more than ``most_spans`` of them reads the whole log. A replayed batch takes the place of
    what it wrote before."""
    cut = F.lit(0) if span is None else span

    def write(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates(keys).withColumn("span", F.coalesce(cut.cast("bigint"), F.lit(-1)))
        if exists(spark, path):
            log = spark.read.schema(f"{df.select(*keys).schema.toDDL()}, span bigint, epoch bigint").option("basePath", path).parquet(path).where(F.col("epoch") < epoch)
            spans = [r.span for r in fresh.select("span").distinct().limit(most_spans + 1).collect()]
            if len(spans) <= most_spans:
                log = log.where(F.col("span").isin(spans))
            same = [fresh[k].eqNullSafe(log[k]) for k in ["span", *keys]]
            on = same[0]
            for c in same[1:]:
                on = on & c
            fresh = fresh.join(log, on, "left_anti")
        fresh.repartitionByRange("span", *keys).sortWithinPartitions("span").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return write
