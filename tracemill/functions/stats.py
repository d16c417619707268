"""Closed-form statistics over per-task counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the difficulty band and the success rate its tasks are lifted to in the ceiling
BAND_LOW = 0.6
BAND_TARGET = 0.95
SUCCESS_TOLERANCE = 1e-6


def is_success(reward: Column, tolerance: float = SUCCESS_TOLERANCE) -> Column:
    return F.abs(reward - F.lit(1.0)) <= F.lit(tolerance)


def subset_ratio(c: Column, n: Column, k: int) -> Column:
    """C(c,k)/C(n,k): the chance that k distinct trials drawn from n are all among the c successes.
    Null when n < k. The product form needs no factorials and cannot overflow."""
    out = F.lit(1.0)
    for i in range(k):
        out = out * F.greatest(c - F.lit(i), F.lit(0)).cast("double") / (n - F.lit(i)).cast("double")
    return F.when(n >= F.lit(k), out)


def beta_moment(a: Column, b: Column, k: int) -> Column:
    """E[p^k] for p ~ Beta(a, b)."""
    out = F.lit(1.0)
    for i in range(k):
        out = out * (a + F.lit(float(i))) / (a + b + F.lit(float(i)))
    return out


def difficulty_band(c: Column, n: Column) -> Column:
    p = c.cast("double") / n.cast("double")
    return (F.when(c == 0, F.lit("never")).when(c == n, F.lit("always"))
            .when(p >= F.lit(BAND_LOW), F.lit("band")).otherwise(F.lit("low")))


def in_band(c: Column, n: Column) -> Column:
    return (c < n) & (c.cast("double") / n.cast("double") >= F.lit(BAND_LOW))


def is_mixed(c: Column, n: Column) -> Column:
    return (c > 0) & (c < n)


def headroom_term(c: Column, n: Column) -> Column:
    """p^4, with band tasks lifted to the target rate."""
    p = c.cast("double") / n.cast("double")
    return F.when(in_band(c, n), F.lit(BAND_TARGET ** 4)).otherwise(F.pow(p, F.lit(4)))


def binomial_se(p: Column, n: Column) -> Column:
    return F.sqrt(F.greatest(p * (F.lit(1.0) - p), F.lit(1e-6)) / F.greatest(n, F.lit(1)).cast("double"))


def product(terms: list[Column], op: Callable[[Column, Column], Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = op(out, t)
    return out
