"""Session settings and the shared folder used for intermediate tables and checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. AQE picks broadcast joins from measured sizes and splits skewed
# partitions; nothing here is specific to one cluster size.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


_local_base: list[str] = []


def build_session(app: str = "tracemill", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**BASE_CONF, **conf}.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared checkpoint folder the cluster names. Only a local master may go without the
    setting (tests, one machine): it gets a temporary folder. A cluster without it is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local_base:
            _local_base.append(tempfile.mkdtemp(prefix="tracemill-"))
        base = _local_base[0]
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


TASK_ROWS = 250_000   # rows a task of ``sized`` gets


def sized(df: DataFrame, rows: int, *keys: str, per: int = TASK_ROWS) -> DataFrame:
    """Shuffle by ``keys`` into as many partitions as ``rows`` need at ``per`` rows a task, so that a task's sorts and hash tables
    stay as they are while the table grows. AQE would join small shuffle blocks until there is one task a core."""
    return df.repartition(max(1, -(-rows // per)), *keys)


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Cut lineage by writing to the shared folder and reading back: survives lost executors, and
    several consumers read the result instead of recomputing it."""
    path = work_folder(df.sparkSession, purpose)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
