"""Every registered query runs on the small tables, and its SQL gives the same rows."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, plain

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(plain(v) for v in r)) for r in df.select(*cols).collect())
    if name not in ORACLES:
        assert got
        return
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == cols
    assert got == Counter(repr(tuple(plain(r[i]) for i in at)) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_contract():
    assert set(ORACLES) <= set(QUERIES)
