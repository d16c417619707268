"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import bpe, dac, decontam, fertility, jaccard, langid, licenses, merkle, mixing, quality, substring, trie, url_lists
from tracemill.llm.common import read
from tracemill.llm.sql import ORACLES  # noqa: F401


def dated_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures; the table has no dates, so the day of the fetch follows from the id."""
    return read(spark, sf_dir, "pages").select("page_id", "url", F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int").alias("day"))


def _number(text) -> F:
    return F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int")


def dated_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List entries derived from the pages: hosts that come and go, domains that stay, short-lived path prefixes."""
    url = F.col("url")
    host = url_lists.host_of(url)
    urls = read(spark, sf_dir, "pages").where("url IS NOT NULL")
    hosts = urls.select(host.alias("host")).where("host != ''").distinct().withColumn("m", _number(F.col("host")))
    coming = hosts.where("m % 3 = 0").select(F.explode(F.expr("""array(
        named_struct('list', if(m % 2 = 0, 'malware', 'adult'), 'kind', 'host', 'value', host, 'action', 'add', 'day', m % 300),
        named_struct('list', if(m % 2 = 0, 'malware', 'adult'), 'kind', 'host', 'value', host, 'action', 'remove', 'day', m % 300 + 60),
        named_struct('list', if(m % 2 = 0, 'malware', 'adult'), 'kind', 'host', 'value', host, 'action', 'add', 'day', m % 300 + 120))""")).alias("e")).select("e.*")
    domains = hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("value")).where("value != ''").distinct().withColumn("m", _number(F.concat(F.lit("d"), "value")))
    staying = domains.where("m % 5 = 0").selectExpr("if(m % 2 = 0, 'allow', 'spam') AS list", "'domain' AS kind", "value", "'add' AS action", "m % 200 AS day")
    first = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)
    prefixes = urls.select(F.concat(host, F.lit("/"), first).alias("value"), host.alias("host"), first.alias("first")).where("host != '' AND first != ''").select("value").distinct()
    short = prefixes.withColumn("m", _number(F.concat(F.lit("p"), "value"))).where("m % 4 = 0").select(F.explode(F.expr("""array(
        named_struct('list', 'phishing', 'kind', 'prefix', 'value', value, 'action', 'add', 'day', m % 330),
        named_struct('list', 'phishing', 'kind', 'prefix', 'value', value, 'action', 'remove', 'day', m % 330 + 30))""")).alias("e")).select("e.*")
    return coming.unionByName(staying).unionByName(short)


def op1_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lists.filtered(dated_captures(spark, sf_dir), dated_entries(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(read(spark, sf_dir, "documents"), 20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.trained(docs, read(spark, sf_dir, "labels"))).select("doc_id", "expected_grade", "tail", "kept")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), 13, 20)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"), 3, 9, 10).select("doc_id", "n_shingles", "component_id")


def op6_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.measure(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licensed(read(spark, sf_dir, "documents"), licenses.notices(spark))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.write_and_read(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.coded(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, checked against a copy in which a third of the texts (by id) has lost its capitals."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf([F.col(c) for c in fields[:-1]] + [lowered]))
    found = merkle.manifest(read(spark, sf_dir, "documents"), fields, also={"shown": shown})
    checked = found.withColumn("start", F.coalesce("shown", "leaf")).select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"),
                                                                          merkle.folded("start").alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(read(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_url_lists, op2_substring_dedup, op3_quality_classifier, op4_benchmark_decontamination, op5_ngram_jaccard,
                                   op6_tokeniser_fertility, op7_language_id, op8_source_mixing, op9_license_scan, op10_token_output, op11_bpe_coding, op12_merkle_manifest, op13_conversation_trie)}
