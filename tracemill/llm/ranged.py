"""Row numbers inside groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import saved


def placed(rows: DataFrame, group: list[str], order: list[str], purpose: str) -> DataFrame:
    """``rows`` with ``pos`` (the row's place in its group from 0, by ``order``, nulls first) and ``n`` (rows of the group).

    Ranges of (group, order) go to tasks, so a group with most of all rows spans many of them; a row's place is its
    place in the task plus the rows of the group in earlier tasks, of which there is one number for each task and group.
    A random last key spreads rows that are equal in all columns named; their places are interchangeable. Group columns
    must not be null; ``rows`` is read twice (once for the range bounds), so hand in a table rather than heavy work."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order, "_spread"]
    dealt = rows.withColumn("_spread", F.rand(11)).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_spread")
    dealt = saved(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), purpose)
    runs = dealt.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    w = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_rows").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumns({"_before": before, "n": F.sum("_rows").over(w)}).drop("_rows")
    found = dealt.join(runs, ["_part", *group]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before"))
    return found.drop("_part", "_at", "_first", "_before")
