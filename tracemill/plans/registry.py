"""The query registry and small helpers shared by the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.plans.sql_types import BIGINT_COLUMNS, DOUBLE_COLUMNS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def narrowed(name: str, sql: str) -> str:
    casts = [f'CAST("{c}" AS {kind}) AS "{c}"' for kind, table in (("BIGINT", BIGINT_COLUMNS), ("DOUBLE", DOUBLE_COLUMNS))
             for c in table.get(name, "").split()]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql}) AS answer" if casts else sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the same question asked of the tables in ANSI SQL."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = narrowed(name, sql)
        return fn
    return add


def r6(c: Column) -> Column:
    return F.round(c, 6)
