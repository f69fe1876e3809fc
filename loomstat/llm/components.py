"""Connected components of a distributed link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.plans.scratch import freeze

# the number of rounds grows with the logarithm of the longest chain; this is far beyond it
MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: each node's neighbours are linked to the least node around it.

    ``large`` links the larger neighbours of a node, otherwise the smaller ones and the node.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    linked = both.join(least, "a")
    if large:
        out = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the least node."""
    edges = freeze(edges.select("a", "b").filter("a <> b"))
    before = None
    for _ in range(MAX_ROUNDS):
        edges = freeze(_star(_star(edges, large=True), large=False))
        mark = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if before == mark:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select("component", "component")).distinct()
