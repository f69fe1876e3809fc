"""Merkle manifest of a table, with a membership proof for every row, by pointer jumping.

Rows of a group are the leaves of the group's tree; the groups' roots are the leaves of the top tree.
Every node of both holds a *segment* towards an ancestor: the siblings it passes on the way, at first those of
its own run and the pointer to its parent. A self-join appends the segment of the ancestor and takes over its pointer,
which doubles the distance; after as many joins as the depth has binary digits every leaf points past the root.
Segments of inner nodes are written once per round, and of them only the nodes that a later round can point at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.plans.keys import attach
from loomstat.plans.limits import broadcast_if_small
from loomstat.plans.positions import POS, range_positions
from loomstat.plans.scratch import freeze

ARITY = 3
# levels of a tree that one group builds, from ARITY ** BLOCK_LEVELS neighbouring nodes at most
BLOCK_LEVELS = 6
# rows numbered by one task
RANGE_ROWS = 500_000
# inner nodes whose segments are broadcast; more are joined by a shuffle, and then few rows share one
BROADCAST_NODES = 10_000
TOP = -1  # number of the top tree
SIBLINGS = "struct<before:string,after:string>"
PATH = f"array<{SIBLINGS}>"


def leaf_hash(*values: Column) -> Column:
    """Hex SHA-256 of the values' texts, each led by its UTF-8 length and a colon; NULL is a dash."""

    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof_digest(path: Column) -> Column:
    """Hex SHA-256 of the siblings of ``path``, bottom up and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    powers = F.array(*[F.lit(ARITY**k) for k in range(39)])
    return F.size(F.filter(powers, lambda p: p < n))


def subtree(hashes: list[str], levels: int) -> list[list[str]]:
    """``hashes`` and the next ``levels`` levels above them."""
    out = [hashes]
    for _ in range(levels):
        below = out[-1]
        out.append([hashlib.sha256("".join(below[i : i + ARITY]).encode()).hexdigest() for i in range(0, len(below), ARITY)])
    return out


def _build(level: int, row_kind: pa.DataType):
    """Groups of neighbouring nodes of one level to all nodes of the next levels.

    ``siblings`` is NULL for nodes that have none in this group: roots, and the tops that the next group starts from.
    ``subroot`` is set where the parent is the root of a group's tree.
    """
    schema = pa.schema(
        [("tree", pa.int64()), ("h", pa.int32()), ("level", pa.int32()), ("idx", pa.int64()), ("hash", pa.string()),
         ("siblings", pa.struct([("before", pa.string()), ("after", pa.string())])), ("subroot", pa.string()), ("row", row_kind)]
    )

    def run(frames):
        for batch in frames:
            out: list[list] = [[] for _ in schema]
            for tree, h, block, nodes in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                steps = min(BLOCK_LEVELS, h - level)
                levels = subtree([n["hash"] for n in nodes], steps)
                for up, hashes in enumerate(levels):
                    first = block * ARITY ** (BLOCK_LEVELS - up)
                    for i, digest in enumerate(hashes):
                        run_at = i - i % ARITY
                        inner = up < steps
                        siblings = {"before": "".join(hashes[run_at:i]), "after": "".join(hashes[i + 1 : run_at + ARITY])} if inner else None
                        subroot = levels[-1][0] if tree != TOP and level + up == max(h - 1, 0) else None
                        row = nodes[i]["row"] if not up else None
                        for column, x in zip(out, (tree, h, level + up, first + i, digest, siblings, subroot, row), strict=True):
                            column.append(x)
                if len(out[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                    out = [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _grow(base: DataFrame, highest: int) -> DataFrame:
    """All nodes of the trees over ``base`` (tree, h, idx, hash, row); ``highest`` is the largest ``h``."""
    row_type = base.schema["row"].dataType
    kind = f"tree long, h int, level int, idx long, hash string, siblings {SIBLINGS}, subroot string, row {row_type.simpleString()}"
    row_kind = _arrow_type(base)
    built, level = [], 0
    while True:
        block = F.expr(f"idx div {ARITY**BLOCK_LEVELS}").alias("block")
        nodes = F.sort_array(F.collect_list(F.struct("idx", "hash", "row"))).alias("nodes")
        groups = base.groupBy("tree", "h", block).agg(nodes)
        nodes = freeze(groups.mapInArrow(_build(level, row_kind), kind))
        level += BLOCK_LEVELS
        built.append(nodes.filter((F.col("level") < level) | (F.col("level") == F.col("h"))))
        if level >= highest:
            break
        base = nodes.filter((F.col("level") == level) & (F.col("h") > level)).select("tree", "h", "idx", "hash", "row")
    out = built[0]
    for part in built[1:]:
        out = out.union(part)
    return out


def _arrow_type(base: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(base.schema["row"].dataType)


def _jump(near: DataFrame, ahead: DataFrame, few: bool) -> DataFrame:
    """``near`` with the segments of the nodes that it points at appended; rows past the root stay."""
    far = ahead.select(
        F.struct("tree", "level", "idx").alias("__id"), F.col("path").alias("__path"), F.col("to").alias("__to"), F.col("subroot").alias("__subroot")
    )
    moving = near.filter("to IS NOT NULL").join(F.broadcast(far) if few else far, F.col("to") == F.col("__id"))
    moved = moving.withColumns(
        {"path": F.concat("path", "__path"), "to": F.col("__to"), "subroot": F.coalesce("subroot", "__subroot")}
    ).drop("__id", "__path", "__to", "__subroot")
    return moved.unionByName(near.filter("to IS NULL"))


def manifest(rows: DataFrame, group: str, order: Sequence[str], leaf: str, root_name: str = "root") -> DataFrame:
    """``rows`` with the columns ``subroot``, ``root`` and ``path``, the siblings from the leaf up to the root.

    ``leaf`` is a row's hash in hex. The rows of a ``group`` (NULL is one) ascend by ``order``, NULL first; rows equal
    there ascend by ``leaf``, and equal rows are leaves of their own. While a tree has several nodes on a level,
    every three consecutive ones, the last run being shorter, are hashed into one. Groups ascend bytewise, NULL first.
    An empty table gives no rows. Names of the columns made here must not be among those of ``rows``.
    """
    columns = rows.columns
    packed = rows.select(
        F.col(group).alias("__group"), *[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)], F.col(leaf).alias("__leaf"),
        F.monotonically_increasing_id().alias("__tie"), F.struct(*columns).alias("row"),
    )
    packed = freeze(packed)
    total = packed.count()
    made = {"subroot": "string", root_name: "string", "path": PATH}
    if not total:
        return rows.limit(0).withColumns({c: F.lit(None).cast(t) for c, t in made.items()})
    placed = range_positions(packed, ["__group"], [*(f"__o{k}" for k in range(len(order))), "__leaf", "__tie"], total, RANGE_ROWS)
    placed = freeze(placed.select("__group", F.col(POS).alias("idx"), F.col("__leaf").alias("hash"), "row"))
    groups = freeze(placed.groupBy("__group").agg((F.max("idx") + 1).alias("n")))
    n_groups, largest = groups.agg(F.count(F.lit(1)), F.max(height(F.col("n")))).first()
    ranked = range_positions(groups, [], ["__group"], n_groups, RANGE_ROWS)
    trees = freeze(ranked.select("__group", F.col(POS).alias("tree"), height(F.col("n")).alias("h")))
    named = attach(placed, broadcast_if_small(trees), ["__group"])
    below = _grow(named.select("tree", "h", "idx", "hash", "row"), largest)

    subroots = below.filter("level = h")
    top_height = next(k for k in range(64) if ARITY**k >= n_groups)
    over = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(top_height).alias("h"), F.col("tree").alias("idx"), "hash", F.lit(0).alias("row"))
    above = _grow(over, top_height)
    root = above.filter("level = h").first()["hash"]

    def started(nodes: DataFrame) -> DataFrame:
        """Segments of distance one; a tree of one leaf starts at its place in the top tree."""
        up, at_top = F.col("level") + 1, F.col("tree") == TOP
        leaves_tree = ~at_top & (up >= F.col("h"))
        parent = F.struct(
            F.when(leaves_tree, F.lit(TOP).cast("long")).otherwise(F.col("tree")).alias("tree"),
            F.when(leaves_tree, 0).otherwise(up).cast("int").alias("level"),
            F.when(leaves_tree, F.col("tree")).otherwise(F.expr(f"idx div {ARITY}")).alias("idx"),
        )
        is_root = (at_top & (up >= F.col("h"))) if top_height else (at_top | leaves_tree)
        return nodes.withColumns(
            {"path": F.when(F.col("siblings").isNull(), F.array().cast(PATH)).otherwise(F.array("siblings")), "to": F.when(~is_root, parent)}
        ).drop("siblings", "h", "hash")

    inner = started(below.filter("level > 0 AND level < h").drop("row").unionByName(above.filter("level < h").drop("row")))
    leaves = started(below.filter("level = 0")).select("path", "to", "subroot", "row")
    distance, reached = 1, 0
    while reached < largest + top_height:
        inner = freeze(inner)
        few = inner.count() <= BROADCAST_NODES
        leaves = _jump(leaves, inner, few)
        reached += distance
        distance *= 2
        # a later round points at these levels only, or at any node of the top tree
        needed = inner.filter((F.col("tree") == TOP) | (F.col("level") % distance == 0))
        inner = _jump(needed, inner, few)
    return leaves.select("row.*", "subroot", F.lit(root).alias(root_name), "path")


def audit(docs: DataFrame, key: str = "doc_id", group: str = "source", text: str = "text", others: Sequence[str] = ("lang", "n_chars")) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``.

    Leaves are made of key, group, first of ``others``, the rest of ``others`` and the text. Where 2 divides the
    CRC-32 of the decimal key, the leaf that is folded is recomputed from the text without line feeds, as if these had been
    lost; ``verified`` tells whether a row's fold still gives the root. A NULL key comes first and is not tampered
    with; NULL and empty texts differ. Equal rows are leaves of their own, an empty table gives no rows, and
    other columns are neither read nor returned.
    """
    lang, *rest = others
    body = F.col(text)
    of = lambda t: leaf_hash(F.col(key), F.col(group), F.col(lang), *[F.col(c) for c in rest], t)
    lost = (F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0) & F.contains(body, F.lit("\n"))
    rows = docs.select(
        F.col(key).alias("key"), F.col(group).alias("of"), of(body).alias("leaf"), F.when(lost, of(F.replace(body, F.lit("\n"), F.lit("")))).alias("shown")
    )
    found = manifest(rows, "of", ["key"], "leaf")
    folded = found.withColumns(
        {"proof_sha256": proof_digest(F.col("path")), "folded_root": fold(F.coalesce("shown", "leaf"), F.col("path"))}
    )
    return folded.select(
        F.col("key").alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
