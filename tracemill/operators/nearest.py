"""The largest Jaccard overlap of each set with any set of a reference list, exactly, without a row per pair.

Elements are ordered by rarity in the list. Pass one gives every set a first value: its overlap with the smallest listed set
that holds its rarest known element. A listed set that does better must share an element of both sets' prefixes, and
its size lies between bounds (all follow from the value so far). The list is cut into blocks by size; for every element
and block one row says how early the element stands and how large the sets are. Pass two sends a set only to the blocks that
these rows leave open, where an inverted index counts all overlaps at once and one best value comes back. Blocks with many
sets sent to them are split by salt, so a task holds at most about BLOCK + SENT elements (or one larger set).

A null or empty set overlaps nothing (0). Repeated elements count once; rows that share an id keep their own value."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators import skew
from tracemill.session import materialise

BLOCK = 200_000           # elements of the listed sets in a block
SENT = 500_000            # elements of the sets sent to one task
SLACK = 1e-9              # for bounds in floating point; what it lets through is counted exactly


def _listed(held: DataFrame, held_id: str, entities: str, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of the list: sets (hid, nh, ents, block), elements (e, freq, hid: the smallest set with it), and
    (e, block, early, lo, hi)."""
    ents = F.array_distinct(F.coalesce(F.array_compact(entities), F.array().cast("array<string>")))
    h = held.select(F.col(held_id).alias("hid"), ents.alias("ents")).where(F.size("ents") > 0).withColumn("nh", F.size("ents"))
    h = h.withColumns({"_all": F.lit(0), "_o": F.col("nh").cast("bigint") * 1048576 + F.pmod(F.xxhash64("hid", "ents"), F.lit(1048576))})
    summed = skew.running(h, ["_all"], [F.col("_o"), F.xxhash64("ents", "hid")], skew.evenly(h, "_o"), {"_sum": F.col("nh").cast("bigint")})
    sets = materialise(summed.select(F.monotonically_increasing_id().alias("hid"), "nh", "ents", F.floor((F.col("_sum") - F.col("nh")) / block).alias("block")), "listed-sets")
    each = sets.select("hid", "nh", "block", F.explode("ents").alias("e"))
    elements = materialise(each.groupBy("e").agg(F.count(F.lit(1)).alias("freq"), F.min(F.struct("nh", "hid")).getField("hid").alias("hid")), "listed-elements")
    ordered = each.join(elements.select("e", "freq"), "e").groupBy("hid", "nh", "block").agg(F.sort_array(F.collect_list(F.struct("freq", "e"))).alias("r"))
    at = ordered.select("nh", "block", F.posexplode("r").alias("q", "x")).select("nh", "block", "q", F.col("x.e").alias("e"))
    spots = at.groupBy("e", "block").agg(F.max((F.col("nh") - F.col("q")) / F.col("nh")).alias("early"), F.min("nh").alias("lo"), F.max("nh").alias("hi"))
    return sets, elements, materialise(spots, "listed-spots")


def _first_values(keyed: DataFrame, sets: DataFrame, elements: DataFrame) -> DataFrame:
    """(key, na, known, n, u): the set's known elements, rarest first, and its first value n / u."""
    each = keyed.select("key", "na", F.explode("ents").alias("e")).join(elements, "e")
    ranked = each.groupBy("key").agg(F.max("na").alias("na"), F.sort_array(F.collect_set(F.struct("freq", "e"))).alias("r"), F.min(F.struct("freq", "e", "hid")).getField("hid").alias("hid"))
    ranked = ranked.select("key", "na", "hid", F.transform("r", lambda x: x["e"]).alias("known"))
    met = ranked.join(sets.select("hid", "nh", "ents"), "hid").withColumn("n", F.size(F.array_intersect("known", "ents")))
    return met.select("key", "na", "known", "n", (F.col("na") + F.col("nh") - F.col("n")).alias("u"))


def routes(first: DataFrame, spots: DataFrame) -> DataFrame:
    """(key, block): the blocks that may hold a better set."""
    value = F.col("n") / F.col("u")
    prefix = F.col("na") - F.expr("(cast(n AS bigint) * na + u - 1) div u") + 1          # of the whole set; unknown elements are the rarest
    left = F.greatest(prefix - (F.col("na") - F.size("known")), F.lit(0)).cast("int")
    sent = first.where("n < u").select("key", "na", value.alias("value"), F.explode(F.slice("known", F.lit(1), left)).alias("e"))
    open_ = (F.col("early") >= F.col("value") - SLACK) & (F.col("hi") >= F.col("value") * F.col("na") - SLACK) & (F.col("lo") * F.col("value") <= F.col("na") + SLACK)
    return sent.join(spots, "e").where(open_).select("key", "block").distinct()


def _best(key, tasks: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
    sizes = listed["nh"].to_numpy().astype(np.int64)
    index: dict[str, list[int]] = {}
    for i, ents in enumerate(listed["ents"]):
        for e in ents:
            index.setdefault(e, []).append(i)
    posts = {e: np.array(i) for e, i in index.items()}
    out = []
    for k, na, known in zip(tasks["key"], tasks["na"], tasks["known"], strict=True):
        hit = [posts[e] for e in known if e in posts]
        if hit:
            n = np.bincount(np.concatenate(hit), minlength=len(sizes))
            u = na + sizes - n
            i = int(np.argmax(n / u))
            out.append((k, int(n[i]), int(u[i])))
    return pd.DataFrame(out, columns=["key", "n", "u"])


def best_overlap(tasks: DataFrame, held: DataFrame, task: str, held_id: str, entities: str = "entities", block: int = BLOCK, sent: int = SENT) -> DataFrame:
    """(task, overlap) for every row of ``tasks``: two columns of its own and ``entities`` as arrays of strings on both sides."""
    none = F.array().cast("array<string>")
    rows = tasks.select(F.col(task), F.array_distinct(F.coalesce(F.array_compact(entities), none)).alias("ents"))
    rows = rows.withColumns({"na": F.size("ents"), "key": F.md5(F.to_json(F.struct(F.col(task).cast("string").alias("t"), F.sort_array("ents").alias("e"))))})
    sets, elements, spots = _listed(held, held_id, entities, block)
    first = materialise(_first_values(rows, sets, elements), "first-values")
    goes = materialise(first.select("key", "na", "known").join(routes(first, spots), "key"), "routes")
    loads = goes.groupBy("block").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size("known")) / sent)).cast("int").alias("salts"))
    loads = materialise(loads, "loads")
    salted = goes.join(loads, "block").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int")).select("block", "salt", "key", "na", "known")
    copies = sets.join(loads, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "nh", "ents")
    better = salted.groupBy("block", "salt").cogroup(copies.groupBy("block", "salt")).applyInPandas(_best, "key string, n long, u long")
    best = first.select("key", F.col("n").cast("bigint").alias("n"), F.col("u").cast("bigint").alias("u")).unionByName(better)
    best = best.groupBy("key").agg(F.max(F.col("n") / F.col("u")).alias("overlap"))
    return rows.select(task, "key").join(best, "key", "left").select(task, F.coalesce("overlap", F.lit(0.0)).alias("overlap"))
