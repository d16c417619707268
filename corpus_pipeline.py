"""A corpus pipeline of five operators: documents in, a token file out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import stages
from tracemill.session import work_folder

STAGES = [
    ("quality classifier", stages.classified),
    ("n-gram Jaccard join", stages.distinct),
    ("benchmark decontamination", stages.clean),
    ("mixing sources to target weights", stages.mixed),
    ("token-ID / binary output", stages.tokens),
]

ORACLE_SQL = None         # the classifier and the tokenizer have no SQL form; tests compare with direct versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each result is a table in the shared folder before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = work_folder(spark, "stage-" + "".join(c if c.isalnum() else "-" for c in name))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
