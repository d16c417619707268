"""A Merkle manifest of a table: one leaf for each row, a tree for each value of a key column, a tree over their roots.

Rows are put in order inside their key and cut into aligned blocks of ``BLOCK`` places. A block keeps each of its levels
as one string of hex digests, 64 characters each: parents hash its fixed-width substrings of eight digests, and the
siblings of a node are the two substrings that flank it in its run. The blocks' roots are the places of the next round, so
the number of rounds is the logarithm of the largest key to base ``BLOCK``; no task holds more than a block. Paths come
back the same way, from the root down to the blocks.

Nulls: a null field counts as ``-``, a null key is a tree of its own, ahead of all others. Rows with a null id come first
in their tree. Rows that share an id stand in the order of their leaves; equal rows are interchangeable. A tree of one row
has that row's leaf as its root; with no path at all a proof is the digest of the empty string. An empty table has no
rows and no root. Columns that are not named take no part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import saved
from tracemill.llm.ranged import placed

RUN = 8                   # nodes that become one parent
INSIDE = 3                # levels inside a block
BLOCK = RUN ** INSIDE
WIDE = 64 * RUN           # characters of a full run
PATH = "array<struct<l:string,r:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _parents(level: str) -> Column:
    return F.expr(f"array_join(transform(sequence(0, (length({level}) - 1) div {WIDE}), j -> sha2(substr({level}, cast(j * {WIDE} + 1 as int), {WIDE}), 256)), '')")


def _blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """(key, at, n, rows): ``BLOCK`` places in order."""
    kept = F.struct("pos", "digest", *payload)
    return nodes.groupBy("key", F.expr(f"pos div {BLOCK}").alias("at")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(kept)).alias("rows"))


def _levels(blocks: DataFrame) -> DataFrame:
    """Adds l0 to l2, the strings of the levels, deep (levels below the block's root) and node, the root's digest."""
    deep = F.expr(f"CASE WHEN n = 1 THEN 0 WHEN n <= {RUN} THEN 1 WHEN n <= {RUN * RUN} THEN 2 ELSE {INSIDE} END")
    out = blocks.withColumn("l0", F.expr("array_join(transform(rows, r -> r.digest), '')")).withColumn("l1", _parents("l0"))
    return out.withColumn("l2", _parents("l1")).withColumn("deep", deep).withColumn("node", F.expr("CASE deep WHEN 0 THEN l0 WHEN 1 THEN l1 WHEN 2 THEN l2 ELSE sha2(l2, 256) END"))


def raised(nodes: DataFrame, payload: list[str], purpose: str) -> list[DataFrame]:
    """The blocks of all rounds, lowest first, each a table in the shared folder. ``nodes`` has key, pos, n, digest."""
    rounds = [saved(_blocks(nodes, payload), purpose)]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > BLOCK:
        above = _levels(rounds[-1].where(F.col("n") > BLOCK)).select(
            "key", F.col("at").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("node").alias("digest"))
        rounds.append(saved(_blocks(above, []), purpose))
    return rounds


def roots(rounds: list[DataFrame]) -> DataFrame:
    """(key, root)."""
    ends = [_levels(b.where(F.col("n") <= BLOCK)).select("key", F.col("node").alias("root")) for b in rounds]
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    return out


def _segment(k: int) -> str:
    """The digests that flank place i in its run on level k of its block."""
    p = f"shiftright(i, {3 * k})"
    run, slot = f"shiftright({p}, 3) * {WIDE}", f"({p} & 7) * 64"
    return f"named_struct('l', substr(l{k}, {run} + 1, {slot}), 'r', substr(l{k}, {run} + {slot} + 65, {WIDE - 64} - {slot}))"


def _opened(blocks: DataFrame, payload: list[str], more: list[str]) -> DataFrame:
    """One row for each place of blocks that know their own path ``up``: the place's path up to the root."""
    inside = ", ".join(_segment(k) for k in range(INSIDE))
    fields = "".join(f", '{c}', r.{c}" for c in payload)
    each = F.expr(f"transform(rows, (r, i) -> named_struct('pos', r.pos, 'digest', r.digest{fields}, 'path', concat(slice(array({inside}), 1, deep), up)))")
    return _levels(blocks).select("key", *more, F.explode(each).alias("e")).select("key", *more, "e.*")


def with_paths(rounds: list[DataFrame], top: DataFrame, payload: list[str]) -> DataFrame:
    """(key, pos, digest, payload, path and what else ``top`` has). ``top`` has one row for each key with ``up``, the path
    of the key's root."""
    more = [c for c in top.columns if c not in ("key", "up")]
    above = None
    for k, blocks in reversed(list(enumerate(rounds))):
        here = blocks.where(F.col("n") <= BLOCK).select("key", "at").join(top, "key")
        up = here if above is None else here.unionByName(above.select("key", F.col("pos").alias("at"), F.col("path").alias("up"), *more))
        above = _opened(blocks.join(up, ["key", "at"]), payload if k == 0 else [], more)
    return above


def manifest(docs: DataFrame, fields: list[str], key: str = "lang", id_col: str = "doc_id", also: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of ``docs``: id_col, leaf, path (segments of siblings from the leaf to the root of all), subroot
    (of its key's tree), root, and the columns of ``also``, which are computed where the leaf is."""
    also = also or {}
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("-")).alias("key"), F.col(id_col).alias("id"),
                       leaf([F.col(c) for c in fields]).alias("digest"), *[v.alias(f"also_{c}") for c, v in also.items()])
    payload = ["id", *[f"also_{c}" for c in also]]
    rounds = raised(placed(saved(rows, "leaves"), ["key"], ["id", "digest"], "placed"), payload, "blocks")
    subroots = saved(roots(rounds), "subroots").select(F.lit("").alias("key"), F.col("key").alias("tree"), F.col("root").alias("digest"))
    over = raised(placed(subroots, ["key"], ["tree"], "trees"), ["tree"], "over")
    top = roots(over).select("key", "root", F.array().cast(PATH).alias("up"))
    trees = with_paths(over, top, ["tree"]).select(F.col("tree").alias("key"), F.col("digest").alias("subroot"), "root", F.col("path").alias("up"))
    found = with_paths(rounds, saved(trees, "tree-paths"), payload)
    return found.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "path", "subroot", "root", *[F.col(f"also_{c}").alias(c) for c in also])


def proof_digest(path: str = "path") -> Column:
    """The digest of all siblings, leaf to root, left to right."""
    return F.sha2(F.expr(f"aggregate({path}, '', (a, s) -> concat(a, s.l, s.r))"), 256)


def folded(start: str, path: str = "path") -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.expr(f"aggregate({path}, {start}, (a, s) -> sha2(concat(s.l, a, s.r), 256))")
