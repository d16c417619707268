"""N-gram Jaccard join by a token-group matrix: documents whose shingle sets have a Jaccard similarity of at least
``num / den`` are linked; every document gets the smallest id that links reach.

1. Sets: a document's distinct shingles as 64-bit hashes. Documents with equal sets fold into one class (they are linked
   by definition), so exact copies cost one row each from here on.
2. Order: a fixed-size frequency sketch over all documents ranks shingles by rarity. Two sets that link share one of the
   rarest 5 % of the smaller and the rarest 10 % of the larger, and lie in the same or neighbouring size class. Classes
   that share no such (shingle, size class) key are alone.
3. Groups: the other classes are partitioned by their smallest shingle hash, so similar ones stand together; a group
   holds about ``GROUP`` classes, larger families are cut by hash.
4. Matrix: (key, group) for the rare keys of a group. First a column's members travel, as queries, to one group of it
   only, its hub. Components of the links found there and inside the groups leave few open columns: those that hold
   several components. Of such a column all members outside its largest component travel to its other groups. A pair of
   one component needs no second link, so no link between components is lost, and a family of near copies is not
   compared group by group. A group with many queries is copied, each copy takes a part of them.
5. Before any set travels, bitmaps of the sets (under a byte a shingle) do. A bit of one set that the other lacks is a
   shingle that the other lacks, which bounds the overlap from above; rows of a group without a partner within that bound
   stay behind. Only the others' sets are sent.
6. A group's task bounds each query by its overlap with the group's token union, opens the group only if that bound
   reaches what the smallest fitting member needs, and then counts exact overlaps.
7. Links are kept as a spanning forest of each task; components, after either round, come from minimum labels with pointer jumping over
   tables. No pair list of a family is written and nothing is gathered on the driver but fixed-size tables.

Null ids sort last. Null or empty texts have no set, link with nothing and are their own component. Rows that share an
id are one node each by (id, text). Inside, a component is (smallest id, class hash): rows with null or repeated ids that
do not link stay apart; only ``join`` maps it to the id."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm import common
from tracemill.operators import skew

SKETCH_BITS = 22          # counters of the frequency sketch, 2^22
PIECE_BITS = 16           # counters of one merge piece
GROUP = 192               # classes of a group, on average
ASKED = 4                 # queries of a copy of a group, in groups' worth
HOT = 1000                # rows from which on a key of the component rounds may be spread
ACTIVE_BITS = 24          # largest bitmap of classes that have a possible partner, 2^24
LAST_ID = 2 ** 63 - 1
SIDES = "doc long, tid long, n int, d1 long, d2 long"
STOP = ["gid", "part", "member", "c1", "c2"]
STOPS = "d1 long, d2 long, gid long, part int, member boolean, c1 long, c2 long"


def shingle_sets(docs: list[list[bytes]], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; fewer words than ``size``: the whole sequence."""
    h, begin = common.hash_docs([[w.lower() for w in d] for d in docs])
    all_windows = common.windows(h, size)
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(all_windows[a:b - size + 1]))
        elif b > a:
            out.append(common.mix(common.windows(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _first_pass(size: int):
    """kind 0: one row a document; kind 1: pieces of this task's frequency sketch."""
    def run(frames):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for pdf, docs in common.chunks(frames):
            sets = shingle_sets(docs, size)
            marks = [common.digest128(s.tobytes()) for s in sets]
            if sets:
                slots, seen = np.unique(np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS), return_counts=True)
                counts[slots.astype(np.int64)] += seen.astype(np.uint32)
            yield pd.DataFrame({"kind": 0, "doc": pdf["doc"].to_numpy(), "tid": pdf["tid"].to_numpy(), "n": [len(s) for s in sets],
                                "d1": [m[0] for m in marks], "d2": [m[1] for m in marks], "piece": 0, "counts": None})
        squeeze = zstandard.ZstdCompressor(level=1)
        for i in range(1 << (SKETCH_BITS - PIECE_BITS)):
            part = counts[i << PIECE_BITS:(i + 1) << PIECE_BITS]
            if part.any():
                yield pd.DataFrame({"kind": [1], "doc": 0, "tid": 0, "n": 0, "d1": 0, "d2": 0, "piece": i, "counts": [squeeze.compress(part.tobytes())]})
    return run


def _merge_counts(frames):
    now, total = None, None
    done = []
    for pdf in frames:
        for piece, counts in zip(pdf["piece"], pdf["counts"], strict=True):
            if piece != now:
                if now is not None:
                    done.append((now, total))
                now, total = piece, np.zeros(1 << PIECE_BITS, np.uint64)
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(counts), np.uint32)
        for p, t in done:
            yield pd.DataFrame({"piece": [p], "rank": [_rank(t)]})
        done = []
    if now is not None:
        yield pd.DataFrame({"piece": [now], "rank": [_rank(total)]})


def _rank(total: np.ndarray) -> bytes:
    """Counts on a logarithmic scale, one byte each: enough to order shingles by rarity."""
    return np.minimum(255, np.log2(total.astype(np.float64) + 1) * 8).astype(np.uint8).tobytes()


def rarity_table(pieces: DataFrame) -> np.ndarray:
    """2^SKETCH_BITS bytes, whatever the number of documents; read by one job, not one for each partition."""
    table = np.zeros(1 << SKETCH_BITS, np.uint8)
    merged = pieces.select("piece", "counts").repartition(F.col("piece")).sortWithinPartitions("piece").mapInPandas(_merge_counts, "piece int, rank binary")
    for r in merged.collect():
        table[r["piece"] << PIECE_BITS:(r["piece"] + 1) << PIECE_BITS] = np.frombuffer(r["rank"], np.uint8)
    return table


def least_overlap(n: int | np.ndarray, m: int | np.ndarray, num: int, den: int):
    """The smallest overlap of sets of n and m with overlap / union >= num / den."""
    return -((-(n + m) * num) // (den + num))


def probe_length(n: int, num: int, den: int) -> int:
    """A partner shares at least ceil(n num / den) shingles, so it shares one of this many."""
    return n - -((-n * num) // den) + 1


def index_length(n: int, num: int, den: int) -> int:
    """A partner that is no smaller shares at least ceil(2 n num / (num + den)), so it shares one of this many."""
    return n - -((-2 * n * num) // (num + den)) + 1


def size_class(n: int, num: int, den: int) -> int:
    """Sizes that can link lie in the same class or the next one."""
    return int(math.log(n) / (math.log(den / num) * 1.0001))


INDEX, PROBE, NEXT = 0, 1, 2      # roles of a key: a shingle of the shorter prefix, one of the longer only, one for the next size class


def prefix_keys(s: np.ndarray, table: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of (rare shingle, size class) with the role in the two low bits."""
    ranks = table[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    n = len(s)
    short, size = index_length(n, num, den), size_class(n, num, den)

    def salt(c: int) -> np.uint64:
        return np.uint64((c * int(common.BASE)) % 2 ** 64)
    rare = s[np.argsort(ranks, kind="stable")[:probe_length(n, num, den)]]
    here = common.mix(rare + salt(size)) & ~np.uint64(3)
    here[short:] |= np.uint64(PROBE)
    over = (common.mix(rare[:short] + salt(size + 1)) & ~np.uint64(3)) | np.uint64(NEXT)
    return np.concatenate((here, over)).view(np.int64)


def _prefixes(size: int, table, num: int, den: int):
    def run(frames):
        for pdf, docs in common.chunks(frames):
            rows = []
            for s in shingle_sets(docs, size):
                if len(s):
                    d1, d2 = common.digest128(s.tobytes())
                    rows.append((d1, d2, int(s[0].view(np.int64)), prefix_keys(s, table.value, num, den)))
            yield pd.DataFrame(rows, columns=["d1", "d2", "least", "keys"])
    return run


def _sets(size: int):
    def run(frames):
        for pdf, docs in common.chunks(frames):
            rows = [(*common.digest128(s.tobytes()), s.tobytes()) for s in shingle_sets(docs, size) if len(s)]
            yield pd.DataFrame(rows, columns=["d1", "d2", "items"])
    return run


def bitmap(s: np.ndarray) -> np.ndarray:
    """A set's shingles by their low bits, in four to eight bits a shingle, as 64-bit words; a power of two of them."""
    slots = s & np.uint64((64 << max(0, math.ceil(math.log2(len(s) / 16)))) - 1)
    words = np.zeros(1 << max(0, math.ceil(math.log2(len(s) / 16))), np.uint64)
    np.bitwise_or.at(words, (slots >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slots & np.uint64(63)))
    return words


def fold(words: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (in the last axis) as they are with only ``width`` words."""
    return np.bitwise_or.reduce(words.reshape(*words.shape[:-1], -1, width), axis=-2)


def _bitmaps(size: int):
    def run(frames):
        for pdf, docs in common.chunks(frames):
            rows = [(*common.digest128(s.tobytes()), len(s), bitmap(s).tobytes()) for s in shingle_sets(docs, size) if len(s)]
            yield pd.DataFrame(rows, columns=["d1", "d2", "n", "bits"])
    return run


def trees(pdf: pd.DataFrame) -> np.ndarray:
    """A number for the component of each row."""
    return pdf.groupby(["c1", "c2"], sort=False).ngroup().to_numpy()


def _possible(num: int, den: int, first: bool = True):
    """Rows of a group that may link with another one of it that is of another component. A pair's overlap is at most either
    size less the bits that the other bitmap lacks. Members are compared with each other in the ``first`` round, in one copy."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["d1", "d2"]).drop_duplicates(["d1", "d2", "member"], ignore_index=True)
        n, member, tree = pdf["n"].to_numpy(np.int64), pdf["member"].to_numpy(bool), trees(pdf)
        inside = first and len(pdf) > 0 and pdf["part"].iat[0] == 0
        words = [np.frombuffer(b, np.uint64) for b in pdf["bits"]]
        width = np.array([len(w) for w in words])
        held = [(w, at, np.stack([words[i] for i in at])) for w in np.unique(width[member]).tolist() for at in [np.flatnonzero(member & (width == w))]]
        keep = np.zeros(len(pdf), bool)
        for q in np.flatnonzero(~member | inside).tolist():
            for w, at, table in held:
                fits = (n[at] * den >= n[q] * num) & (n[q] * den >= n[at] * num) & (tree[at] != tree[q])
                if member[q]:
                    fits &= at > q
                if fits.any():
                    narrow = min(w, int(width[q]))
                    a, b, m = fold(words[q], narrow), fold(table[fits], narrow), n[at[fits]]
                    most = np.minimum(n[q] - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), m - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
                    near = at[fits][most >= least_overlap(n[q], m, num, den)]
                    keep[near] = True
                    keep[q] |= len(near) > 0
        return pdf.loc[keep, ["d1", "d2", *STOP]]
    return run


class Forest:
    """Union-find over the members of one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _open(members: list[np.ndarray], queries: list[np.ndarray], forest: Forest, num: int, den: int, inside: bool):
    """Yield (query, member) links that join two trees. The group is an inverted index over its token union."""
    sizes = np.array([len(m) for m in members])
    order = np.argsort(np.concatenate(members), kind="stable")
    tokens = np.concatenate(members)[order]
    owner = np.repeat(np.arange(len(members)), sizes)[order]
    union, first = np.unique(tokens, return_index=True)
    ends = np.append(first[1:], len(tokens))
    offset = 0 if inside else len(members)
    for q, s in enumerate(queries):
        fits = (sizes * den >= len(s) * num) & (len(s) * den >= sizes * num)
        if inside:
            fits[:q + 1] = False
        if not fits.any():
            continue
        at = np.searchsorted(union, s)
        at[at == len(union)] = 0
        hit = at[union[at] == s]
        if len(hit) < least_overlap(len(s), int(sizes[fits].min()), num, den):
            continue                      # the bound: no fitting member can share more than the union does
        span = ends[hit] - first[hit]
        begin = np.repeat(first[hit] - np.concatenate(([0], np.cumsum(span)[:-1])), span)
        shared = np.bincount(owner[begin + np.arange(int(span.sum()))], minlength=len(members))
        for m in np.flatnonzero(fits & (shared * (den + num) >= (sizes + len(s)) * num)).tolist():
            if forest.join(offset + q, m):
                yield q, m


def _linked(num: int, den: int, first: bool):
    """Links between components: of the members of a group (in the first round, in one copy) and of its members with the
    queries sent to it."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["d1", "d2"]).drop_duplicates(["d1", "d2", "member"])
        pdf = pd.concat([pdf[pdf["member"]], pdf[~pdf["member"]]], ignore_index=True)
        k = int(pdf["member"].sum())
        if not k:
            return pd.DataFrame([], columns=["a1", "a2", "b1", "b2"])
        sets = [np.frombuffer(b, np.uint64) for b in pdf["items"]]
        forest, seen = Forest(len(sets)), {}
        for i, t in enumerate(trees(pdf).tolist()):
            forest.join(seen.setdefault(t, i), i)
        found = list(_open(sets[:k], sets[:k], forest, num, den, True)) if first and pdf["part"].iat[0] == 0 else []
        found += [(k + q, m) for q, m in _open(sets[:k], sets[k:], forest, num, den, False)]
        # each joined component is linked with the one of its tree's root: a star takes fewer rounds than a chain
        ends = list(map(tuple, pdf[["c1", "c2"]].to_numpy().tolist()))
        stars = dict.fromkeys((ends[i], ends[forest.root(i)]) for link in found for i in link)
        return pd.DataFrame([(*a, *b) for a, b in stars if a != b], columns=["a1", "a2", "b1", "b2"])
    return run


def live_keys(keys: DataFrame) -> DataFrame:
    """Keys (with their role) that some other class can meet. An INDEX key also serves as probe of its own class."""
    role = F.col("key").bitwiseAND(F.lit(3))
    met = keys.groupBy(F.shiftright("key", 2).alias("at")).agg(*[F.count(F.when(role == r, 1)).alias(f"n{r}") for r in (INDEX, PROBE, NEXT)])
    fits = {INDEX: "n0 + n1 + n2 > 1", PROBE: "n0 + n2 > 0", NEXT: "n0 + n1 > 0"}
    kept = F.array_compact(F.array(*[F.when(F.expr(f"n{r} > 0 AND {fits[r]}"), F.shiftleft("at", 2).bitwiseOR(F.lit(r))) for r in fits]))
    return met.select(F.explode(kept).alias("key"))


def classes_joined(docs: DataFrame, size: int = 3, num: int = 9, den: int = 10) -> tuple[DataFrame, DataFrame]:
    """(rows, tops): rows has doc, tid, n, d1, d2 of every document; tops (d1, d2, component) of every class."""
    spark = docs.sparkSession
    # the whole hash of the text: with null or repeated ids it alone tells the rows apart
    keyed = common.rows_keyed(docs).select("doc", F.xxhash64("text").alias("tid"), "text")
    first = common.saved(keyed.mapInPandas(_first_pass(size), f"kind int, {SIDES}, piece int, counts binary"), "sets")
    table = spark.sparkContext.broadcast(rarity_table(first.where("kind = 1")))
    rows = first.where("kind = 0").select("doc", "tid", "n", "d1", "d2")
    # one document speaks for its class; the bitmap may let a few more through
    heads = rows.where("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("doc", "tid")).alias("head")).select("d1", "d2", "head.doc", "head.tid")
    heads = common.saved(heads, "heads")
    active = common.bits_for(heads.count(), ACTIVE_BITS)

    def spoken(chosen: DataFrame) -> DataFrame:
        bits = common.bit_table(chosen.select(F.xxhash64("doc", "tid").alias("key")), "key", active)
        return keyed.where(common.has_bit(bits, F.xxhash64("doc", "tid"), active))
    prefixes = spoken(heads).mapInPandas(_prefixes(size, table, num, den), "d1 long, d2 long, least long, keys array<long>")
    prefixes = common.saved(prefixes.groupBy("d1", "d2").agg(F.first("least").alias("least"), F.first("keys").alias("keys")), "prefixes")
    live = common.saved(live_keys(prefixes.select(F.explode("keys").alias("key"))), "live")
    alive = common.bits_for(live.count(), ACTIVE_BITS)
    lit = common.bit_table(live.select(F.xxhash64("key").alias("key")), "key", alive)
    # classes with a key that another class may meet; the rest are alone
    met = prefixes.select("d1", "d2", "least", F.explode("keys").alias("key")).where(common.has_bit(lit, F.xxhash64("key"), alive))
    met = met.join(live, "key", "left_semi")        # the bitmap lets some more keys through
    met = common.saved(met.groupBy("d1", "d2").agg(F.first("least").alias("least"), F.collect_list("key").alias("keys")), "met")

    per = met.groupBy("least").agg(F.count(F.lit(1)).alias("same"))
    n_groups = F.greatest(F.lit(1), F.floor(met.agg(F.count(F.lit(1)).alias("n")).scalar() / GROUP))
    # small families are packed together, large ones are cut into parts of about GROUP classes
    gid = F.when(F.col("same") <= GROUP, F.pmod(F.xxhash64("least"), n_groups)).otherwise(
        F.xxhash64("least", F.pmod(F.xxhash64("d1", "d2"), F.ceil(F.col("same") / GROUP))))
    grouped = common.saved(met.join(per, "least").select("d1", "d2", "keys", gid.alias("gid")), "groups")

    def found(stops: DataFrame, first: bool) -> DataFrame:
        def sent_to(stops: DataFrame, make, what: str):
            speakers = heads.join(stops.select("d1", "d2").distinct(), ["d1", "d2"], "left_semi")
            return spoken(speakers).mapInPandas(make, f"d1 long, d2 long, {what}").join(stops, ["d1", "d2"]).groupBy("gid", "part")
        possible = sent_to(stops, _bitmaps(size), "n int, bits binary").applyInPandas(_possible(num, den, first), STOPS)
        possible = common.saved(possible, "possible")
        return common.saved(sent_to(possible, _sets(size), "items binary").applyInPandas(_linked(num, den, first), "a1 long, a2 long, b1 long, b2 long"), "links")

    classes = rows.where("n > 0").groupBy("d1", "d2").agg(F.min("doc").alias("doc")).select("d1", "d2", F.struct("doc", "d1", "d2").alias("label"))
    sent = common.saved(to_hubs(grouped), "sent")
    alone = grouped.withColumns({"c1": F.col("d1"), "c2": F.col("d2")})
    near = components(classes, found(common.saved(stops_of(alone, sent, True), "stops"), True))
    marked = grouped.join(near, ["d1", "d2"], "left").select(*grouped.columns, F.coalesce("label.d1", "d1").alias("c1"), F.coalesce("label.d2", "d2").alias("c2"))
    marked = common.saved(marked, "marked")
    rest = common.saved(to_others(marked).join(sent, ["d1", "d2", "gid"], "left_anti"), "rest")
    if rest.isEmpty():
        return rows, classes.join(near.withColumnRenamed("label", "least"), ["d1", "d2"], "left").select("d1", "d2", F.coalesce("least", "label").alias("component"))
    far = components(classes, found(common.saved(stops_of(marked, rest, False), "stops"), False))
    top = classes.join(near.withColumnRenamed("label", "least"), ["d1", "d2"], "left").select("d1", "d2", F.coalesce("least", "label").alias("label"))
    sizes = top.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    over = common.saved(far.select(F.col("label").alias("component"), "d1", "d2").join(
        sizes.select("label", "size", "label.d1", "label.d2"), ["d1", "d2"]).select("label", "size", "component"), "over")
    both = skew.attach(common.saved(top, "near"), over, ["label"], "size", ["d1", "d2"], "left", min_rows=HOT)
    return rows, both.select("d1", "d2", F.coalesce("component", "label").alias("component"))


def cells(grouped: DataFrame, *more: str) -> DataFrame:
    """The matrix with its members: (column, role, group, class)."""
    one = grouped.select("d1", "d2", "gid", *more, F.explode("keys").alias("key"))
    return one.select("d1", "d2", "gid", *more, F.shiftright("key", 2).alias("at"), F.col("key").bitwiseAND(F.lit(3)).alias("role"))


def meet(role: str, its: str) -> Column:
    """Roles of one key that a pair may share: two longer prefixes alone, or two next size classes, say nothing."""
    return (F.col(role) != F.col(its)) | (F.col(role) == INDEX)


def to_hubs(grouped: DataFrame) -> DataFrame:
    """(d1, d2, gid): members addressed to the hub of each column that they share with another group."""
    hubs = cells(grouped).groupBy("at").agg(F.min(F.struct("role", "gid")).alias("hub"), F.min("gid").alias("low"), F.max("gid").alias("high"), F.count(F.lit(1)).alias("n"))
    hubs = common.saved(hubs.where("low < high").select("at", "n", F.col("hub.role").alias("its"), F.col("hub.gid").alias("to")), "hubs")
    sent = skew.attach(cells(grouped), hubs, ["at"], "n", ["d1", "d2"], min_rows=HOT)
    return sent.where((F.col("gid") != F.col("to")) & meet("role", "its")).select("d1", "d2", F.col("to").alias("gid")).distinct()


def to_others(marked: DataFrame) -> DataFrame:
    """(d1, d2, gid): members outside the largest component of a column, addressed to the column's other groups. Two that are
    both outside it meet in the group with the larger number, unless the other one holds members of the largest too."""
    tree = F.struct("c1", "c2")
    ends = cells(marked, "c1", "c2").groupBy("at").agg(F.min("gid").alias("low"), F.max("gid").alias("high"), F.min(tree).alias("one"), F.max(tree).alias("two"), F.count(F.lit(1)).alias("n"))
    several = common.saved(ends.where("low < high AND one < two").select("at", "n"), "several")
    open_cells = common.saved(skew.attach(cells(marked, "c1", "c2"), several, ["at"], "n", ["d1", "d2"], min_rows=HOT), "open")
    sizes = open_cells.groupBy("at", "c1", "c2").agg(F.count(F.lit(1)).alias("size"))
    largest = common.saved(sizes.groupBy("at").agg(F.max(F.struct("size", "c1", "c2")).alias("top"), F.sum("size").alias("held")), "largest")
    held = skew.attach(open_cells.drop("n"), largest, ["at"], "held", ["d1", "d2"], min_rows=HOT)
    held = common.saved(held.withColumn("major", (F.col("c1") == F.col("top.c1")) & (F.col("c2") == F.col("top.c2"))).drop("top", "held"), "held")
    groups = held.groupBy("at", "gid", "role").agg(F.min(tree).alias("one"), F.max(tree).alias("two"), F.max("major").alias("has_major")).withColumnsRenamed({"gid": "to", "role": "its"})
    met = held.where("NOT major").join(groups, "at").where((F.col("gid") != F.col("to")) & meet("role", "its") & ((F.col("to") > F.col("gid")) | F.col("has_major")))
    return met.where((F.col("one") != tree) | (F.col("two") != tree)).select("d1", "d2", F.col("to").alias("gid")).distinct()


def stops_of(grouped: DataFrame, sent: DataFrame, first: bool) -> DataFrame:
    """Members at home and queries where they are sent, with their components. A group has a copy for every ASKED * GROUP
    queries; in the first round every group is there, else those with queries."""
    asked = common.saved(sent.groupBy("gid").agg(F.count(F.lit(1)).alias("asked")).withColumn(
        "parts", F.ceil(F.col("asked") / (ASKED * GROUP)).cast("int")), "asked")
    home = grouped.select("d1", "d2", "gid", "c1", "c2").join(asked.select("gid", "parts"), "gid", "left" if first else "inner")
    home = home.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).withColumn("member", F.lit(True))
    queries = skew.attach(sent, asked, ["gid"], "asked", ["d1", "d2"], min_rows=HOT).join(grouped.select("d1", "d2", "c1", "c2"), ["d1", "d2"])
    queries = queries.withColumn("part", F.pmod(F.xxhash64("d1", "d2"), F.col("parts")).cast("int")).withColumn("member", F.lit(False))
    return home.select("d1", "d2", *STOP).unionByName(queries.select("d1", "d2", *STOP))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(d1, d2, label): the smallest label that edges reach, for classes with an edge. ``nodes`` has d1, d2, label.
    Each round takes the smallest label around a class and jumps to that label's own label; every round is a table. Once no
    label changes, the ends of every edge have the same one: the smallest of their component."""
    both = edges.select("a1", "a2", "b1", "b2").unionByName(edges.selectExpr("b1 as a1", "b2 as a2", "a1 as b1", "a2 as b2"))
    ends = both.groupBy(F.col("a1").alias("d1"), F.col("a2").alias("d2")).agg(F.count(F.lit(1)).alias("degree"))
    now = common.saved(nodes.join(ends, ["d1", "d2"]).select("d1", "d2", F.col("label").alias("own"), "label", "degree"), "labels")
    near = both.select("a1", "a2", F.col("b1").alias("d1"), F.col("b2").alias("d2"))
    for end, other in (("b", ["a1", "a2"]), ("a", ["b"])):              # a class may end many edges
        stats = now.select("d1", "d2", F.col("own").alias(end), "degree")
        near = skew.attach(near, stats, ["d1", "d2"], "degree", other, min_rows=HOT).drop("d1", "d2", "degree")
        near = near.withColumnsRenamed({"a1": "d1", "a2": "d2"})
    near = common.saved(near.select("a", "b"), "near")
    while True:
        there = now.select(F.col("own").alias("b"), F.col("label").alias("there"), "degree")
        seen = skew.attach(near, there, ["b"], "degree", ["a"], min_rows=HOT).groupBy("a").agg(F.min("there").alias("there"))
        # hooking also the old label onto the new one, else long chains take one round a step
        better = now.join(seen, now["own"] == seen["a"], "left").select("d1", "d2", "own", "degree", "label", F.least("label", "there").alias("new"))
        hooks = better.where("new < label").groupBy("label").agg(F.min("new").alias("hook")).withColumnRenamed("label", "at")
        low = better.join(hooks, better["own"] == hooks["at"], "left").select("d1", "d2", "own", "degree", F.col("label").alias("old"), F.least("new", "hook").alias("new"))
        low = common.saved(low, "low")
        if low.where("new < old").isEmpty():
            return low.select("d1", "d2", F.col("new").alias("label"))
        # the label of a large component is asked for by all its classes
        jump = low.groupBy("new").agg(F.count(F.lit(1)).alias("n")).join(low.select(F.col("own").alias("new"), F.col("new").alias("over")), "new")
        step = skew.attach(low, jump, ["new"], "n", ["own"], "left", min_rows=HOT)
        now = common.saved(step.select("d1", "d2", "own", "degree", F.coalesce("over", "new").alias("label")), "labels")


def labelled(docs: DataFrame, size: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """doc, tid, n_shingles, component (doc, d1, d2) of every document: the smallest id that links reach and the class
    that has it, so components that share an id stay apart; null for documents without words."""
    rows, top = classes_joined(docs, size, num, den)
    full = rows.where("n > 0")
    # a class may hold a large share of all rows: both sides are tables, so AQE can split the rows' side
    top = common.saved(top, "tops")
    linked = full.join(top, ["d1", "d2"], "left").select("doc", "tid", F.col("n").cast("bigint").alias("n_shingles"), "component")
    alone = rows.where("n = 0").select("doc", "tid", F.lit(0).cast("bigint").alias("n_shingles"))
    return linked.unionByName(alone, allowMissingColumns=True)


def join(docs: DataFrame, size: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """doc_id, tid, n_shingles, component_id: one row a document."""
    found = labelled(docs, size, num, den).withColumn("component", F.coalesce("component.doc", "doc"))
    real = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return found.select(real("doc").alias("doc_id"), "tid", "n_shingles", real("component").alias("component_id"))
