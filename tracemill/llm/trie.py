"""A prefix trie of conversations: node table with minimal perfect hashes, shard by shard.

A node is a distinct sequence of the first d turns of any conversation; its name is a 128-bit digest, the exclusive or
of strong hashes of (place, turn) over its turns, so digests of long conversations are composed from parts. The rows
(conversation, depth) lie in order in shards of at most ``SHARD`` rows; a conversation may cross shards. In a shard every
distinct digest gets a slot of a minimal perfect hash, verified against the digest that the slot holds, and what is
counted is scattered into flat arrays by slot. Shards' counts meet by digest.

Of the members of a node the smallest owns it. An owner's other prefixes are the node's ancestors, so the shard that has
the owner's rows has the way up to the root: each shard adds what its conversations own into their nodes and then, from
the deepest level up, every slot into its parent's slot. Where a conversation crosses shards the later ones' sums enter the
earlier one at its last row. No step needs all the conversations of a node, nor all turns of one conversation, in a task.

A digest with two different parents or last turns would be a collision; the job stops then rather than merge nodes.

Rows without a conv_id belong to no conversation and are left out. Rows of one turn number stand in the order of
their digests; equal rows are separate turns. Null roles and texts are empty. A table without conversations has no nodes.
Columns that are not named take no part."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import WORD, mix, saved
from tracemill.llm.ranged import placed

SHARD = 100_000           # rows of a shard
PACK = 10_000             # ids in one packed run of a node's ends
SPREAD = 20               # conversations that share a head
HEADS = 4                 # heads have fewer turns than this


# ---- rebuilding ------------------------------------------------------------------------------------------------------

def turns(conversations: DataFrame) -> DataFrame:
    """(conv, turn, t, words): a digest of role and text, and the words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("t"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))


def head_turns(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % HEADS


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv, depth, t, words, length): the rebuilt turns of every conversation from depth 1, and its depth 0 (t null).
    length is the number of its rebuilt turns."""
    found = saved(placed(saved(turns(conversations), "turns"), ["conv"], ["turn", "t"], "placed-turns"), "own-turns")
    sizes = found.where("pos = 0").select("conv", "n")
    base = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = sizes.withColumns({"h": head_turns(F.col("conv")), "base": F.col("conv") - F.col("conv") % SPREAD}).join(base, "base", "left")
    convs = convs.withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("length", F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    convs = saved(convs.select("conv", "base", "h", "m", "length"), "convs")
    own = found.where(F.col("pos") >= head_turns(F.col("conv"))).join(convs, "conv").select(
        "conv", (F.col("pos") - F.col("h") + F.col("m") + 1).alias("depth"), "t", "words", "length")
    heads = found.where(F.col("pos") < HEADS - 1).where(F.col("conv") % SPREAD == 0).select(F.col("conv").alias("base"), "pos", "t", "words")
    heads = heads.join(convs, "base").where("pos < h").select("conv", (F.col("pos") + 1).alias("depth"), "t", "words", "length")
    top = convs.select("conv", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("string").alias("t"), F.lit(0).cast("bigint").alias("words"), "length")
    return own.unionByName(heads).unionByName(top)


# ---- prefix digests --------------------------------------------------------------------------------------------------

def _cut(limit: int):
    """Sorted rows into shards, with the exclusive or of f1, f2 over the conversation's rows in the shard."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, nth, held, conv, x1, x2 = TaskContext.get().partitionId(), 0, 0, None, np.int64(0), np.int64(0)
        waiting = None                                            # the row before, until it is known whether its shard ends

        def piece(pdf):
            nonlocal conv, x1, x2
            ids = pdf["conv"].to_numpy()
            new = np.concatenate(([conv is None or ids[0] != conv], ids[1:] != ids[:-1]))
            start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
            for name, carry in (("1", x1), ("2", x2)):
                run_ = np.bitwise_xor.accumulate(pdf["f" + name].to_numpy())
                before = np.where(start > 0, run_[np.maximum(start - 1, 0)], 0)
                pdf["x" + name] = np.where(start < 0, run_ ^ carry, run_ ^ before)
            conv, x1, x2 = ids[-1], pdf["x1"].to_numpy()[-1], pdf["x2"].to_numpy()[-1]
            return pdf
        for pdf in frames:
            while len(pdf):
                take, pdf = pdf.iloc[:limit - held].copy(), pdf.iloc[limit - held:]
                first = held == 0
                take["shard"] = (part << 32) + nth
                take["edge"] = 0
                out = piece(take)
                out.loc[out.index[0], "edge"] = 1 if first else 0  # 1: first row of a shard, 2: last row, 3: both
                held += len(out)
                if waiting is not None:
                    if first:
                        waiting["edge"] += 2
                    yield waiting
                yield out.iloc[:-1]
                waiting = out.iloc[-1:].copy()
                if held == limit:
                    nth, held, conv, x1, x2 = nth + 1, 0, None, np.int64(0), np.int64(0)
        if waiting is not None:
            waiting["edge"] += 2
            yield waiting
    return run


def paths(rows: DataFrame, limit: int = SHARD) -> DataFrame:
    """The rows of ``rebuilt`` with their prefix's digest (x1, x2), their parent's (f1, f2 taken out) and their shard;
    ``goes_on`` says that the conversation began in an earlier shard."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    f1 = F.when(F.col("t").isNull(), F.lit(0)).otherwise(F.xxhash64("t", "depth")).cast("bigint")
    f2 = F.when(F.col("t").isNull(), F.lit(0)).otherwise(F.xxhash64("depth", "t", F.lit("second"))).cast("bigint")
    rows = saved(rows.withColumns({"f1": f1, "f2": f2}), "rebuilt")
    dealt = rows.repartitionByRange(parts, "conv", "depth").sortWithinPartitions("conv", "depth")
    kind = "conv long, depth long, t string, words long, length long, f1 long, f2 long, x1 long, x2 long, shard long, edge int"
    cut = saved(dealt.mapInPandas(_cut(limit), kind), "cut")
    edges = cut.where("edge > 0").select("shard", "conv", "x1", "x2", F.explode(F.expr("filter(array(1, 2), k -> (edge & k) != 0)")).alias("kind"))
    w = Window.partitionBy("conv").orderBy("shard", "kind").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.col("kind") == 2
    carried = edges.select("shard", "conv", "kind", F.bit_xor(F.when(ended, F.col("x1"))).over(w).alias("c1"), F.bit_xor(F.when(ended, F.col("x2"))).over(w).alias("c2"))
    carried = saved(carried.where("kind = 1 AND c1 IS NOT NULL").select("shard", "conv", "c1", "c2"), "carried")
    full = cut.join(carried, ["shard", "conv"], "left").withColumns({
        "x1": F.col("x1").bitwiseXOR(F.coalesce("c1", F.lit(0))), "x2": F.col("x2").bitwiseXOR(F.coalesce("c2", F.lit(0))), "goes_on": F.col("c1").isNotNull()})
    return full.drop("c1", "c2", "edge")


# ---- minimal perfect hash --------------------------------------------------------------------------------------------

KEY = np.dtype([("a", np.int64), ("b", np.int64)])


def keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), KEY)
    out["a"], out["b"] = a, b
    return out


class Slots:
    """A minimal perfect hash of distinct 128-bit keys: on each level the keys that fall alone into a place of a bit array
    get the rank of that place, the others go to the next level. Every slot keeps its key, and a look-up is checked
    against it."""

    def __init__(self, distinct: np.ndarray):
        self.held, self.levels, self.n = np.empty(len(distinct), KEY), [], len(distinct)
        left, given = distinct, 0
        while len(left):
            size = 2 * len(left) + 1
            place = self._place(left, len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            ranks = np.cumsum(alone) - 1 + given
            mine = alone[place]
            self.held[ranks[place[mine]]] = left[mine]
            self.levels.append((size, alone, ranks))
            given += int(alone.sum())
            if len(self.levels) > 64:
                raise ValueError("the keys are not distinct")
            left = left[~mine]
        if len(np.unique(self.of(distinct))) != self.n:
            raise ValueError("two keys share a slot")

    @staticmethod
    def _place(k: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2 ** 64)
        h = mix(k["a"].astype(np.uint64) + seed) ^ k["b"].astype(np.uint64)
        return (mix(h) % np.uint64(size)).astype(np.int64)

    def of(self, k: np.ndarray) -> np.ndarray:
        """The slots of known keys; an unknown key is an error."""
        out, left = np.full(len(k), -1, np.int64), np.arange(len(k))
        for level, (size, alone, ranks) in enumerate(self.levels):
            if not len(left):
                break
            place = self._place(k[left], level, size)
            hit = alone[place]
            out[left[hit]] = ranks[place[hit]]
            left = left[~hit]
        if len(left) or not np.array_equal(self.held[out], k):
            raise KeyError("a key has no slot of its own")
        return out


# ---- shards ----------------------------------------------------------------------------------------------------------

NODE = "x1 long, x2 long, p1 long, p2 long, depth long, t string, words long, n_convs long, n_end long, owner long"


def _counted(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's distinct prefixes with members, ends and smallest member."""
    k = keys(pdf["x1"].to_numpy(), pdf["x2"].to_numpy())
    distinct, at = np.unique(k, return_index=True)
    slots = Slots(distinct)
    slot = slots.of(k)
    n_convs = np.bincount(slot, minlength=slots.n)
    n_end = np.bincount(slot[(pdf["depth"] == pdf["length"]).to_numpy()], minlength=slots.n)
    owner = np.full(slots.n, np.iinfo(np.int64).max)
    np.minimum.at(owner, slot, pdf["conv"].to_numpy())
    row = np.empty(slots.n, np.int64)
    row[slots.of(distinct)] = at
    one = pdf.iloc[row]
    return pd.DataFrame({"x1": slots.held["a"], "x2": slots.held["b"], "p1": (one["x1"] ^ one["f1"]).to_numpy(), "p2": (one["x2"] ^ one["f2"]).to_numpy(),
                         "depth": one["depth"].to_numpy(), "t": one["t"].to_numpy(), "words": one["words"].to_numpy(), "n_convs": n_convs, "n_end": n_end, "owner": owner})


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's part of what lies below each of its prefixes: children, childless nodes, saved tokens."""
    pdf = pdf.sort_values(["conv", "depth"], kind="stable")
    k = keys(pdf["x1"].to_numpy(), pdf["x2"].to_numpy())
    up = keys((pdf["x1"] ^ pdf["f1"]).to_numpy(), (pdf["x2"] ^ pdf["f2"]).to_numpy())
    conv, depth, owned, goes_on = (pdf[c].to_numpy() for c in ("conv", "depth", "owned", "goes_on"))
    slots = Slots(np.unique(np.concatenate((k, up))))
    slot, parent, level = slots.of(k), np.full(slots.n, -1, np.int64), np.full(slots.n, -1, np.int64)
    inner = depth > 0
    parent[slot[inner]] = slots.of(up[inner])
    level[slot] = depth
    children = np.zeros(slots.n, np.int64)
    np.add.at(children, parent[slot[owned & inner]], 1)
    last = np.concatenate((conv[1:] != conv[:-1], [True]))        # what later shards own below the conversation's last row here
    childless = (pdf["n_convs"] == pdf["n_end"]).to_numpy().astype(np.int64)
    sums = []
    order = np.argsort(-level, kind="stable")
    order = order[level[order] > 0]
    levels = np.split(order, np.flatnonzero(np.diff(level[order])) + 1) if len(order) else ()
    for own, later in ((childless, "later_leaves"), (((pdf["n_convs"] - 1) * pdf["words"]).to_numpy(), "later_tokens")):
        value = np.where(owned, own, 0) + np.where(last, pdf[later].to_numpy(), 0)
        total = np.zeros(slots.n, np.int64)
        np.add.at(total, slot[~goes_on], value[~goes_on])
        for some in levels:
            np.add.at(total, parent[some], total[some])
        # a conversation that began in an earlier shard: its way up is there, and other rows here may share its prefixes
        np.add.at(total, slot[goes_on], np.cumsum(value[goes_on][::-1])[::-1])
        sums.append(total)
    some = (children != 0) | (sums[0] != 0) | (sums[1] != 0)
    return pd.DataFrame({"x1": slots.held["a"][some], "x2": slots.held["b"][some], "n_children": children[some], "n_leaves": sums[0][some], "saved_tokens": sums[1][some]})


def node_table(full: DataFrame) -> DataFrame:
    """One row for each distinct prefix; a digest that stands for two sequences stops the job."""
    found = full.groupBy("shard").applyInPandas(_counted, NODE).groupBy("x1", "x2").agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("depth").alias("depth"), F.min("t").alias("t"), F.max("words").alias("words"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_end").alias("n_end"), F.min("owner").alias("owner"),
        F.max("p1").alias("q1"), F.max("p2").alias("q2"), F.max("depth").alias("deep"), F.max("t").alias("u"))
    same = "p1 = q1 AND p2 = q2 AND depth = deep AND t <=> u"
    return found.withColumn("n_convs", F.when(F.expr(same), F.col("n_convs")).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("bigint"))).drop("q1", "q2", "deep", "u")


def sums_below(full: DataFrame, nodes: DataFrame) -> DataFrame:
    """(x1, x2, n_children, n_leaves, saved_tokens)."""
    zero = F.lit(0).cast("bigint")
    owned = nodes.select(F.col("owner").alias("conv"), "depth", F.lit(True).alias("owned"), "n_convs", "n_end")
    known = full.join(owned, ["conv", "depth"], "left").select(
        "shard", "conv", "depth", "words", "f1", "f2", "x1", "x2", "goes_on", F.coalesce("owned", F.lit(False)).alias("owned"),
        F.coalesce("n_convs", zero).alias("n_convs"), F.coalesce("n_end", zero).alias("n_end"))
    known = saved(known, "known")
    spans = known.where("goes_on").select("conv").distinct()
    pieces = known.join(spans, "conv", "left_semi").groupBy("conv", "shard").agg(
        F.sum(F.expr("if(owned AND n_convs = n_end, 1, 0)")).alias("leaves"), F.sum(F.expr("if(owned, (n_convs - 1) * words, 0)")).alias("tokens"))
    w = Window.partitionBy("conv").orderBy(F.desc("shard")).rowsBetween(Window.unboundedPreceding, -1)
    later = pieces.select("conv", "shard", F.sum("leaves").over(w).alias("later_leaves"), F.sum("tokens").over(w).alias("later_tokens"))
    shards = known.join(saved(later, "later"), ["conv", "shard"], "left").withColumns({c: F.coalesce(c, zero) for c in ("later_leaves", "later_tokens")})
    return shards.groupBy("shard").applyInPandas(_summed, "x1 long, x2 long, n_children long, n_leaves long, saved_tokens long").groupBy("x1", "x2").agg(
        *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])


# ---- ends ------------------------------------------------------------------------------------------------------------

def _packed(limit: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids = None, []
        for pdf in frames:
            out = []
            for x1, x2, conv in zip(pdf["x1"].tolist(), pdf["x2"].tolist(), pdf["conv"].tolist(), strict=True):
                if (x1, x2) != key or len(ids) == limit:
                    if ids:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = (x1, x2), []
                ids.append(conv)
            if out:
                yield pd.DataFrame(out, columns=["x1", "x2", "first", "ids"])
        if ids:
            yield pd.DataFrame([(*key, ids[0], ",".join(map(str, ids)))], columns=["x1", "x2", "first", "ids"])
    return run


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, state = None, None
    for pdf in frames:
        out = []
        for x1, x2, ids in zip(pdf["x1"].tolist(), pdf["x2"].tolist(), pdf["ids"].tolist(), strict=True):
            if (x1, x2) == key:
                state.update(b",")
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (x1, x2), hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield pd.DataFrame(out, columns=["x1", "x2", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=["x1", "x2", "ends_sha256"])


def ends(full: DataFrame, limit: int = PACK) -> DataFrame:
    """(x1, x2, ends_sha256) of nodes where conversations end. Ids go in order into packed runs, wherever they lie; only
    the runs of a node meet in one task, which streams them through the hash (it is sequential by its nature)."""
    parts = int(full.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ended = saved(full.where("depth = length").select("x1", "x2", "conv"), "ended")
    runs = ended.repartitionByRange(parts, "x1", "x2", "conv").sortWithinPartitions("x1", "x2", "conv").mapInPandas(_packed(limit), "x1 long, x2 long, first long, ids string")
    return runs.repartition(parts, "x1", "x2").sortWithinPartitions("x1", "x2", "first").mapInPandas(_hashed, "x1 long, x2 long, ends_sha256 string")


def trie(conversations: DataFrame, shard: int = SHARD, pack: int = PACK) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    full = saved(paths(rebuilt(conversations), shard), "paths")
    nodes = saved(node_table(full), "nodes")
    owners = nodes.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("owner").alias("parent_conv_id"))
    below, ended = sums_below(full, nodes), ends(full, pack)
    found = nodes.join(below, ["x1", "x2"], "left").join(ended, ["x1", "x2"], "left").join(owners, ["p1", "p2"], "left")
    zero = F.lit(0).cast("bigint")
    return found.select(F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs",
                        *[F.coalesce(c, zero).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")],
                        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
