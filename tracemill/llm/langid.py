"""Language ID by compression: a text is encoded with one zstandard raw-content dictionary per language; the language with
the fewest bytes wins, and a narrow margin to the second rejects the guess.

A dictionary is the joined text of learning documents with the smallest seeded hash, up to ``DICT_BYTES`` (a documented
bound; only for the dictionary a long text gives a run of ``TAKE`` characters from a seeded place anywhere in it). A text to be told is encoded whole, in
blocks of ``BLOCK`` bytes, so that a long text does not become its own dictionary. Both are lower-cased first, and ASCII
signs and digits become single spaces.

Learning documents are those whose crc32 of the id (as text) is not 0 modulo ``FOLDS``, with text and language. A text
without a letter, or null, is ``und`` with score 0. With no learned language all are ``und``."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS = 5
DICT_BYTES = 30_000
TAKE = 1_000
PER_LANGUAGE = 200        # learning documents looked at per language
BLOCK = 2_048
LEVEL = 3
MARGIN = 0.005            # the second language must need this share more bytes


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def taken(text: Column, seed: Column) -> Column:
    """``TAKE`` characters from a seeded place of the whole text, without the word that the place cuts."""
    at = F.pmod(seed, F.greatest(F.char_length(text) - TAKE, F.lit(0)) + 1).cast("int")
    run = F.substr(text, at + 1, F.lit(TAKE))
    return F.when(at > 0, F.regexp_replace(run, r"^\S{0,40}\s+", "")).otherwise(run)


def dictionaries(docs: DataFrame, per_language: int = PER_LANGUAGE, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Raw content by language: at most ``dict_bytes`` each. The top-n is cut before the shuffle, so a language with most
    rows sends few of them."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = learn.select(F.col("lang").cast("string").alias("lang"), taken(F.col("text").cast("string"), F.xxhash64("text", "doc_id")).alias("text"), F.xxhash64("doc_id", "text").alias("at"))
    some = rows.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("at", "text"))).where(F.col("nth") <= per_language)
    found: dict[str, bytes] = {}
    for r in some.orderBy("lang", "nth").toLocalIterator():
        held = found.get(r["lang"], b"")
        if len(held) < dict_bytes:
            found[r["lang"]] = (held + b" " + letters(r["text"]))[:dict_bytes]
    return found


KEEP = bytes(c if 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def letters(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(KEEP).split())


def coder(content: bytes) -> zstandard.ZstdCompressor:
    """Matches of three bytes count: words are short. Frames carry nothing but the data."""
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=3, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
    raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=raw)


class Coders:
    def __init__(self, found: dict[str, bytes]):
        self.langs = sorted(found)
        self.coders = [coder(found[name]) for name in self.langs]

    def tell(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted)."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, False
        raw = letters(text)
        cost = np.zeros(len(self.langs))
        for i in range(0, len(raw), BLOCK):
            block = raw[i:i + BLOCK]
            cost += [len(c.compress(block)) for c in self.coders]
        order = np.argsort(cost, kind="stable")
        if len(order) == 1:
            return self.langs[0], 1.0, True
        best, second = cost[order[0]], cost[order[1]]
        margin = (second - best) / best
        return self.langs[order[0]], 1.0 / (1.0 + math.exp(-50.0 * margin)), bool(margin >= MARGIN)


_loaded: dict[int, Coders] = {}


def _told(found):
    def run(frames):
        key = id(found.value)
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = Coders(found.value)
        coders = _loaded[key]
        for pdf in frames:
            told = [coders.tell(t) for t in pdf["text"]]
            out = pd.DataFrame(told, columns=["lang_pred", "score", "accepted"])
            yield pd.concat([pdf[["doc_id", "held_out"]].reset_index(drop=True), out], axis=1)
    return run


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, dict_bytes: int = DICT_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every row."""
    found = docs.sparkSession.sparkContext.broadcast(dictionaries(docs, per_language, dict_bytes))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(_told(found), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
