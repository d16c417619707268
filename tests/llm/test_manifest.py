"""The Merkle manifest against a direct version: several rounds of blocks, nulls, repeated rows, one row, no rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracemill.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, digest string, pos string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(digests):
    """The root, and each place's siblings (left, right) from the bottom up."""
    paths, level, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a // 8 * 8:a // 8 * 8 + 8]
            paths[i].append(("".join(run[:a % 8]), "".join(run[a % 8 + 1:])))
        at = [a // 8 for a in at]
        level = [h(*level[j:j + 8]) for j in range(0, len(level), 8)]
    return (level[0] if level else None), paths


def direct(rows):
    trees = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        vals = [doc_id, source, lang, n_chars, text]
        low = None if text is None else "".join(c.lower() if c.isascii() else c for c in text)
        leaf = h(*map(field, vals))
        shown = h(*map(field, [*vals[:4], low])) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else leaf
        trees["-" if lang is None else "=" + lang].append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, shown))
    names = sorted(trees, key=str.encode)
    for k in names:
        trees[k].sort()
    subs = {k: climb([x[2] for x in trees[k]]) for k in names}
    root, over = climb([subs[k][0] for k in names])
    out = []
    for k, up in zip(names, over, strict=True):
        for (_, doc_id, leaf, shown), path in zip(trees[k], subs[k][1], strict=True):
            at = shown
            for left, right in path + up:
                at = h(left, at, right)
            out.append((doc_id, leaf, subs[k][0], root, h(*[left + right for left, right in path + up]), at, at == root))
    return out


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 3, "y", "z") for r in rows], SCHEMA)
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf([F.col(c) for c in FIELDS[:-1]] + [low]))
    df = merkle.manifest(docs, FIELDS, also={"shown": shown}).withColumn("start", F.coalesce("shown", "leaf"))
    df = df.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("p"), merkle.folded("start").alias("f"))
    return [tuple(r) for r in df.withColumn("v", F.col("f") == F.col("root")).collect()]


def some(n, lang, begin=0):
    return [(begin + i, ["Ab É", "lower", "", None, "X" * 3000][i % 5] if i % 5 != 1 else f"lower {i}", lang, [None, "s"][i % 2], i) for i in range(n)]


CASES = {
    "a key of several blocks": some(1300, "en") + some(513, None, 5000) + some(512, "de", 9000) + some(9, "fr", 20000) + some(1, "", 30000),
    "nulls and repeated rows": [(None, "Q", "en", None, None)] * 3 + [(None, None, None, None, None)] * 2 + [(7, "T", "en", "a", 1), (7, "U", "en", "a", 1)] + [(7, "T", "en", "a", 1)] * 9,
    "one row": some(1, "en"),
    "one key of eight": some(8, "en"),
    "many keys": [(i, "T", f"l{i:03d}", None, 1) for i in range(70)],
}


@pytest.mark.parametrize("name", CASES)
def test_manifest_against_direct(spark, name):
    assert Counter(found(spark, CASES[name])) == Counter(direct(CASES[name]))


def test_manifest_of_nothing(spark):
    assert found(spark, []) == []


def test_third_round(spark):
    """Blocks of blocks: positions given by hand, the digests of 512 * 512 + 1 places."""
    n = 512 * 512 + 1
    nodes = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("pos"), F.lit(n).cast("long").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    rounds = merkle.raised(nodes, [], "test")
    assert len(rounds) == 3
    top = merkle.roots(rounds).select("key", "root", F.array().cast(merkle.PATH).alias("up"))
    want, _ = climb_root([h(str(i)) for i in range(n)])
    assert [r.root for r in top.collect()] == [want]
    some = merkle.with_paths(rounds, top, []).where("pos % 40000 = 0 OR pos >= 262143").select("pos", merkle.folded("digest").alias("f")).collect()
    assert {r.f for r in some} == {want} and {r.pos for r in some} == {*range(0, n, 40000), 262143, 262144}


def climb_root(level):
    deep = 0
    while len(level) > 1:
        level, deep = [h(*level[j:j + 8]) for j in range(0, len(level), 8)], deep + 1
    return level[0], deep
