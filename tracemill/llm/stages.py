"""The operators as stages of a corpus pipeline: documents in, documents out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import common, dac, decontam, jaccard, mixing, quality


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it learns from the table of labels."""
    return quality.select(docs, common.read(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard of at least 0.8; op5's query has its own
    three words and 0.9): the one with the smallest id (then text hash). Documents without words stay; of rows equal in
    id and text one stays."""
    found = common.saved(jaccard.labelled(docs, 5, 4, 5), "joined")
    best = found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct("doc", "tid")).alias("best"))
    best = common.saved(best, "best")
    lost = found.where("n_shingles > 0").join(best, "component").where((F.col("doc") != F.col("best.doc")) | (F.col("tid") != F.col("best.tid"))).select("doc", "tid")
    again = found.groupBy("doc", "tid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc", "tid")
    lost, again = common.saved(lost.distinct(), "lost"), common.saved(again, "again")
    clear, maybe = common.flagged(docs, lost.unionByName(again), tid_bits=64)
    left = maybe.join(lost, ["doc", "tid"], "left_anti")
    # one of the rows equal in id and text, combined before the shuffle: such a group may be of any size
    return clear.unionByName(left.groupBy("doc", "tid").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark. Null and empty texts have no words and stay; rows that share an id
    are judged by their own text, repeated rows alike; empty tables keep all or give none."""
    found = decontam.contamination(docs, common.read(spark, sf_dir, "benchmark")).where("contaminated")
    bad = common.saved(found.select(F.coalesce("doc_id", F.lit(2 ** 63 - 1)).alias("doc"), "tid").distinct(), "bad")
    clear, maybe = common.flagged(docs, bad, tid_bits=64)
    return clear.unionByName(maybe.join(bad, ["doc", "tid"], "left_anti").select("row.*"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, once for each pass. Texts without words are in no pass; null sources are a
    source; rows that share id and text are documents of their own; an empty table gives none."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places, lengths and checksums of the documents in the token file, by id (null last) and text; null and empty texts have
    their end id alone; an empty table gives none."""
    return dac.write_and_read(docs, public_tokenizers.path("word_bpe_49k.json"))
