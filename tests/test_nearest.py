"""The exact best overlap against brute force: common words, ties, nulls, small blocks and forced salts."""

import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import nearest as N

SCHEMA = "id long, entities array<string>, key string, n int, block string"


def brute(tasks, held):
    def value(a, b):
        a, b = {x for x in a or [] if x is not None}, {x for x in b or [] if x is not None}
        return len(a & b) / len(a | b) if a and b else 0.0
    return sorted(((i, max((value(a, b) for _, b in held), default=0.0)) for i, a in tasks), key=str)


def found(spark, tasks, held, **kw):
    t = spark.createDataFrame([(i, e, "k", 1, "b") for i, e in tasks], SCHEMA)
    h = spark.createDataFrame([(i, e, "k", 1, "b") for i, e in held], SCHEMA)
    return sorted((tuple(r) for r in N.best_overlap(t, h, "id", "id", **kw).collect()), key=str)


def sets(seed, n, vocabulary, most, common=()):
    r = random.Random(seed)
    return [(i, [*common, *r.sample(vocabulary, r.randint(0, most))]) for i in range(n)]


V = [f"w{i}" for i in range(60)]
CASES = {
    "random": (sets(1, 80, V, 20), sets(2, 50, V, 20)),
    "a word common to all": (sets(3, 80, V, 12, ["the"]), sets(4, 50, V, 12, ["the"])),
    "equal sets": (sets(5, 30, V, 10), sets(5, 30, V, 10)),
    "very different sizes": (sets(6, 20, V, 60, V[:5]), [(i, V[i:i + 1 + i % 3]) for i in range(50)]),
    "nothing shared": (sets(7, 10, V[:30], 9), sets(8, 10, V[30:], 9)),
    "nulls, empties, repeats and shared ids": ([(None, ["a", "b"]), (1, None), (1, []), (1, ["a"]), (1, ["a", "b", "b", None]), (1, ["a", "b", "b", None]), (2, ["z"])],
                                              [(None, None), (5, []), (5, ["a", "b", "c"]), (5, ["a", None, "a"]), (None, ["b"])]),
    "an empty list": (sets(9, 5, V, 5), []),
    "no sets": ([], sets(9, 5, V, 5)),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("kw", [{}, {"block": 15, "sent": 20}], ids=["one block", "many blocks"])
def test_best_overlap_against_brute_force(spark, name, kw):
    tasks, held = CASES[name]
    got, want = found(spark, tasks, held, **kw), brute(tasks, held)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want])


def test_rows_go_to_blocks_not_to_pairs(spark):
    """400 sets that all share a word with all 400 listed ones: 160,000 pairs, of which no row is made."""
    tasks, held = sets(11, 400, V, 30, ["the"]), sets(12, 400, V, 30, ["the"])
    t = spark.createDataFrame([(i, e) for i, e in tasks], "id long, entities array<string>")
    h = spark.createDataFrame([(i, e) for i, e in held], "id long, entities array<string>")
    listed, elements, spots = N._listed(h, "id", "entities", 700)
    rows = t.select(F.col("id").cast("string").alias("key"), F.col("entities").alias("ents"), F.size("entities").alias("na"))
    first = N._first_values(rows, listed, elements)
    blocks = listed.select("block").distinct().count()
    n = N.routes(first, spots).count()
    assert blocks > 5 and first.count() == 400 and n <= 400 * blocks and n < 160_000 / 10
    assert listed.groupBy("block").agg(F.sum("nh").alias("n")).agg(F.max("n")).first()[0] <= 700 + 31
