"""Deterministic draws. A draw is a function of (seed, purpose, key), so it does not depend on
partitioning, retries or row order, and the same value comes out of any engine with md5/sha256."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int | str, purpose: str, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), *[k.cast("string") for k in keys]))


def uniform(seed: int | str, purpose: str, *keys: Column) -> Column:
    """A number in [0, 1) with 32 random bits."""
    return F.conv(F.substring(digest(seed, purpose, *keys), 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)


def draw_below(seed: int | str, purpose: str, bound: int, *keys: Column) -> Column:
    """An integer in [0, bound)."""
    return F.floor(uniform(seed, purpose, *keys) * F.lit(float(bound))).cast("bigint")


def weighted_choice(u: Column, options: dict[str, float]) -> Column:
    """The option whose cumulative-weight interval holds u. Options come from configuration."""
    total = float(sum(options.values()))
    names = list(options)
    acc, out = 0.0, F
    for name in names[:-1]:
        acc += options[name] / total
        out = out.when(u < F.lit(acc), F.lit(name))
    return out.otherwise(F.lit(names[-1])) if len(names) > 1 else F.lit(names[0])


def sha_mod_1000(text: Column) -> Column:
    """int(sha256 hex, 16) mod 1000, folded over 32-bit pieces so it stays inside a bigint."""
    h = F.sha2(text, 256)
    pieces = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(8)]
    acc = F.lit(0).cast("bigint")
    for p in pieces:
        acc = (acc * F.lit(4294967296) + p) % F.lit(1000)
    return acc


def roll(key: Column, salt: str, p: float) -> Column:
    """True for a share p of keys, chosen by hash."""
    return sha_mod_1000(F.concat(F.lit(salt + ":"), key)).cast("double") < F.lit(p * 1000)


def remainders(key: Column, salts: list[str]) -> Column:
    """``sha_mod_1000`` of the key under up to six salts, ten bits each, in one number. Reading a digest as numbers costs SQL
    functions several times the digest itself, so one Arrow function makes all digests of a key."""
    heads = [f"{salt}:".encode() for salt in salts]
    if len(heads) > 6:
        raise ValueError("six salts fill a bigint")

    @F.pandas_udf("bigint")
    def packed(keys: pd.Series) -> pd.Series:
        none, raws = keys.isna().to_numpy(), [b"" if k is None else k.encode("utf-8", "surrogatepass") for k in keys.tolist()]
        out = np.zeros(len(raws), np.int64)
        for j, head in enumerate(heads):
            pieces = np.frombuffer(b"".join([hashlib.sha256(head + r).digest() for r in raws]), ">u4").reshape(-1, 8)
            rest = np.zeros(len(raws), np.int64)
            for i in range(8):
                rest = (rest * 4294967296 + pieces[:, i]) % 1000
            out |= rest << 10 * j
        return pd.Series(out).astype("Int64").mask(none)
    return packed(key.cast("string"))


def rolled(remainders: Column, at: int, p: float) -> Column:
    """``roll`` for the salt at this place."""
    return F.shiftright(remainders, 10 * at).bitwiseAND(F.lit(1023)).cast("double") < F.lit(p * 1000)


def sha_is_even(text: Column) -> Column:
    """Parity of the sha256 number."""
    return F.substring(F.sha2(text, 256), -1, 1).isin("0", "2", "4", "6", "8", "a", "c", "e")


def set_digest(text: Column) -> list[Column]:
    """Aggregates whose joint value identifies a multiset of texts whatever their order: the count and
    two sums of 40-bit pieces of their md5. Combines before the shuffle, unlike sorting the texts."""
    h = F.md5(text)

    def piece(start: int) -> Column:
        return F.sum(F.conv(F.substring(h, start, 10), 16, 10).cast("decimal(20,0)"))
    return [F.count(text).alias("n"), piece(1).alias("d1"), piece(11).alias("d2")]
