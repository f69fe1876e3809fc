"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 16 four-bit segments. One differing bit
moves one count by one, so the Manhattan distance of two count vectors is at most the number of
differing bits: fingerprints that link at two bits lie within distance two on the count grid.
Two such points share a grid cell at distance one or less from both; every fingerprint is put
into the 33 cells around its own, cells are joined, and the members of a cell are compared
exactly. A cell fuller than ``CELL_ROWS`` is not compared pair by pair: its members are keyed by
all fingerprints at one differing bit or less (65 keys), where members of one key differ by two
bits at most, so each links to the smallest of its key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.llm.components import components
from loomstat.llm.text import LOWER, row_id, texts
from loomstat.plans.limits import broadcast_if_small
from loomstat.plans.scratch import freeze

SEED = 42
SHINGLE = 3
BITS = 2
SEGMENTS = 16
# members of a grid cell that are compared with each other
CELL_ROWS = 64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of one text, repeats included; 0 for a text without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        grams = [line[a:b] for a, b in spans]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(grams))
    ones = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), 65536):
        part = hashes[begin : begin + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) with fp as a signed long, for every row; other columns are left out."""

    def run(frames):
        for batch in frames:
            values = np.fromiter((fingerprint(t) for t in texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["key", "fp"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp long")


def _cells(frames):
    """Rows (cell, fp): the cell of a fingerprint's bit counts and its 32 neighbours."""
    step = np.uint64(4)
    for batch in frames:
        fp = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
        nibbles = [np.bitwise_count((fp >> np.uint64(4 * s)) & np.uint64(15)).astype(np.uint64) for s in range(SEGMENTS)]
        own = np.zeros(len(fp), np.uint64)
        for s, n in enumerate(nibbles):
            # counts are 0 to 4; one is added so that a neighbour's -1 to 5 fits four bits
            own |= (n + np.uint64(1)) << np.uint64(4 * s)
        cells = [own]
        for s in range(SEGMENTS):
            one = np.uint64(1) << (step * np.uint64(s))
            cells += [own + one, own - one]
        cell = np.concatenate(cells).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.tile(fp.view(np.int64), 33))], names=["cell", "fp"])


def _roots(cell: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Index of the first member reachable inside the same cell; rows are sorted by (cell, fp)."""
    n = len(cell)
    left, right = [], []
    offset = 1
    alive = np.arange(n - 1)
    while len(alive):
        alive = alive[alive + offset < n]
        alive = alive[cell[alive] == cell[alive + offset]]
        near = alive[np.bitwise_count(fp[alive] ^ fp[alive + offset]) <= BITS]
        left.append(near)
        right.append(near + offset)
        offset += 1
    root = np.arange(n)
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
            if np.array_equal(before, root):
                break
    return root


def _links(frames):
    """Links inside cells. Rows arrive sorted by cell; a cell may go on in the next batch."""
    rest = None
    kept = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def link(cell, fp):
        root = _roots(cell, fp.view(np.uint64))
        moved = np.flatnonzero(root != np.arange(len(root)))
        pairs = np.unique(np.stack([fp[root[moved]], fp[moved]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=kept)

    for batch in frames:
        cell, fp = (np.asarray(batch.column(k)).astype(np.int64) for k in (0, 1))
        if rest is not None:
            cell, fp = np.concatenate([rest[0], cell]), np.concatenate([rest[1], fp])
        if not len(cell):
            continue
        cut = int(np.searchsorted(cell, cell[-1], side="left"))
        rest = cell[cut:], fp[cut:]
        if cut:
            yield link(cell[:cut], fp[:cut])
    if rest is not None and len(rest[0]):
        yield link(*rest)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) links that connect every two of the distinct ``fp`` that differ in two bits or less.

    Not every close pair is a row, but any two are connected through rows.
    """
    cells = distinct.select("fp").mapInArrow(_cells, "cell long, fp long")
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    sizes = freeze(sizes.filter("n > 1"))
    shared = cells.join(sizes.filter(F.col("n") <= CELL_ROWS).select("cell"), "cell", "left_semi")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = (
        shared.repartition(parts, "cell").sortWithinPartitions("cell", "fp").mapInArrow(_links, "a long, b long")
    )
    full = cells.join(sizes.filter(F.col("n") > CELL_ROWS).select("cell"), "cell", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long") for b in range(64)])
    keyed = full.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("k"))
    least = keyed.groupBy("k").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z").select("k", "a")
    across = keyed.join(least, "k").filter("a <> fp").select("a", F.col("fp").alias("b"))
    return inside.union(across).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``.

    ``component_id`` is the smallest key that can be reached over links of two differing bits or
    less. NULL and empty texts have fingerprint zero and link like any other. Repeated keys give
    a row each; a NULL key has no number, so a component of such rows alone has a NULL id. An empty
    table gives no rows. Columns besides key and text are neither read nor returned.
    """
    prints = freeze(fingerprints(docs, key, text))
    distinct = prints.groupBy("fp").agg(F.min("key").alias("least"))
    joined = components(links(distinct))
    named = distinct.join(joined, distinct.fp == joined.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    named = freeze(named)
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = named.join(ids, "component").select(F.col("fp").alias("own"), "component_id")
    return prints.join(of_print, prints.fp == of_print.own).select(
        F.col("key").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of each near-duplicate component of ``docs`` with the smallest key.

    Rows of one key are told apart by their texts, in order of their ``row_id``. Rows without a key come after all
    others: they stay if their component has no keyed row. Of rows that agree in key and text one stays, whichever it is;
    only such rows are shuffled with their texts. NULL and empty texts link like any other. An empty table gives no rows.
    """
    own = row_id(F.col(key), F.col(text))
    ordered = docs.select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), own.alias("id")).alias("__row"), text)
    found = near_duplicates(ordered, "__row", text)
    judged = found.groupBy(F.col("__row.id").alias("__of")).agg(
        F.max(F.col("__row.id") != F.col("component_id.id")).alias("__gone"), (F.count(F.lit(1)) > 1).alias("__again")
    )
    judged = freeze(judged.filter("__gone OR __again"))
    gone, again = (broadcast_if_small(judged.filter(c).select("__of")) for c in ("__gone", "__again AND NOT __gone"))
    named = docs.withColumn("__id", own)
    kept = named.join(gone, F.col("__id") == F.col("__of"), "left_anti")
    single = kept.join(again, F.col("__id") == F.col("__of"), "left_anti")
    several = named.join(again, F.col("__id") == F.col("__of"), "left_semi").dropDuplicates(["__id"])
    return single.union(several).drop("__id")
