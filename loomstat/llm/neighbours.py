"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are made distinct and dealt to shards by their hash. A shard's graph has layers: the bottom one holds all
nodes, each layer above the first ``1 / LINKS`` of them, and a layer is one flat array of neighbour numbers, ``-1``
where a node has fewer. Nodes enter a layer in batches: a batch is searched in what stands already, from
the place that the layers above lead to, and linked to neighbours that are nearer to it than to each other. Searches
go down the layers and end with a beam at the bottom. Every query block meets every shard; the nearest of each are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstat.plans.limits import broadcast_if_small
from loomstat.plans.scratch import freeze

# neighbours per node, twice as many in the bottom layer
LINKS = 16
# places that a search keeps, while building and at the end, and in the layers above
BUILD_WIDTH = 64
SEARCH_WIDTH = 96
DESCENT_WIDTH = 8
# nodes expanded per step of a search, and nodes that enter a layer together
EXPANDED = 4
BATCH = 512
# distinct vectors per shard: what one task holds as a graph
SHARD_ROWS = 4096
# queries that are searched together in a shard
QUERY_BLOCK = 1024
# magnitudes within a shard that single precision tells apart
SINGLE_SPREAD = 1e6
_FAR = np.inf


@dataclass
class Graph:
    """Vectors, their squared norms, and the layers' neighbours from the top to the bottom."""

    vectors: np.ndarray
    norms: np.ndarray
    layers: list[np.ndarray]

    def beam(self, links: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ``width`` nearest nodes met from ``start``, nearest first, and their squared distances less the query's norm."""
        n = len(queries)
        seen = np.zeros((n, len(links)), bool)
        ids = np.full((n, width), -1, np.int64)
        far = np.full((n, width), _FAR, queries.dtype)
        done = np.ones((n, width), bool)
        ids[:, 0], done[:, 0] = start, False
        far[:, 0] = self.norms[start] - 2 * np.einsum("ij,ij->i", self.vectors[start], queries)
        seen[np.arange(n), start] = True
        active = np.arange(n)
        while len(active):
            open_far = np.where(done[active], _FAR, far[active])
            best = np.argsort(open_far, axis=1)[:, :EXPANDED] if width > EXPANDED else np.argmin(open_far, axis=1)[:, None]
            live = np.isfinite(np.take_along_axis(open_far, best, 1))
            going = live[:, 0]
            active, best, live = active[going], best[going], live[going]
            if not len(active):
                break
            near = np.where(live[:, :, None], links[np.where(live, ids[active[:, None], best], 0)], -1).reshape(len(active), -1)
            done[active[:, None], best] = True
            row, column = np.nonzero((near >= 0) & ~seen[active[:, None], near])
            # a node that several of the expanded ones lead to counts once
            first = np.unique(row * len(links) + near[row, column], return_index=True)[1]
            row, column = row[first], column[first]
            node, at = near[row, column], active[row]
            seen[at, node] = True
            found = np.full(near.shape, _FAR, queries.dtype)
            found[row, column] = self.norms[node] - 2 * np.einsum("ij,ij->i", self.vectors[node], queries[at])
            every = np.concatenate((far[active], found), axis=1)
            keep = np.argpartition(every, width - 1, axis=1)[:, :width]
            far[active] = np.take_along_axis(every, keep, 1)
            ids[active] = np.take_along_axis(np.concatenate((ids[active], near), axis=1), keep, 1)
            done[active] = np.take_along_axis(np.concatenate((done[active], ~np.isfinite(found)), axis=1), keep, 1)
        order = np.argsort(far, axis=1, kind="stable")
        far = np.take_along_axis(far, order, 1)
        return np.where(np.isfinite(far), np.take_along_axis(ids, order, 1), -1), far

    def descend(self, layers: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
        """The node that the given upper layers lead each query to."""
        at = np.zeros(len(queries), np.int64)
        for links in layers:
            at = self.beam(links, queries, at, DESCENT_WIDTH)[0][:, 0]
        return at

    def search(self, queries: np.ndarray, width: int = SEARCH_WIDTH) -> np.ndarray:
        """Numbers of the ``width`` nearest nodes found for each query, nearest first, ``-1`` past the last."""
        queries = queries.astype(self.vectors.dtype)
        return self.beam(self.layers[-1], queries, self.descend(self.layers[:-1], queries), width)[0]

    def spread(self, centre: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` neighbours of each centre: first candidates nearer to it than to any chosen one, then the nearest others."""
        out = np.full((len(centre), most), -1, np.int64)
        for begin in range(0, len(centre), 256):
            c = candidates[begin : begin + 256]
            around = self.vectors[c]
            apart = around - self.vectors[centre[begin : begin + 256]][:, None, :]
            far = np.where(c >= 0, np.einsum("ijk,ijk->ij", apart, apart), _FAR)
            order = np.argsort(far, axis=1, kind="stable")
            c, far = np.take_along_axis(c, order, 1), np.take_along_axis(far, order, 1)
            around = np.take_along_axis(around, order[:, :, None], 1)
            norm = np.einsum("ijk,ijk->ij", around, around)
            between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(around, around.transpose(0, 2, 1))
            chosen = np.zeros(c.shape, bool)
            for k in range(c.shape[1]):
                nearest = np.where(chosen, between[:, k], _FAR).min(axis=1)
                chosen[:, k] = (far[:, k] < nearest) & (c[:, k] >= 0) & (chosen.sum(axis=1) < most)
            # chosen ones first, then by distance
            rank = np.argsort(np.where(chosen, 0, 1) + np.where(c >= 0, 0, 2), axis=1, kind="stable")[:, :most]
            picked = np.take_along_axis(c, rank, 1)
            out[begin : begin + 256, : picked.shape[1]] = picked
        return out


def build(vectors: np.ndarray, links: int = LINKS) -> Graph:
    """The graph of distinct vectors, which enter in the given order."""
    graph = Graph(vectors, np.einsum("ij,ij->i", vectors, vectors), [])
    sizes = [len(vectors)]
    while sizes[-1] > links:
        sizes.append(-(-sizes[-1] // links))
    for depth, size in enumerate(reversed(sizes)):
        most = 2 * links if depth == len(sizes) - 1 else links
        layer = np.full((size, most), -1, np.int64)
        inside = 1
        while inside < size:
            batch = np.arange(inside, min(size, inside + min(BATCH, max(inside, 16))))
            start = graph.descend(graph.layers, vectors[batch])
            start = np.where(start < inside, start, 0)
            found = graph.beam(layer[:inside], vectors[batch], start, BUILD_WIDTH)[0]
            mutual = graph.norms[batch][None, :] - 2 * vectors[batch] @ vectors[batch].T
            np.fill_diagonal(mutual, _FAR)
            peers = batch[np.argsort(mutual, axis=1)[:, : min(links, len(batch) - 1)]]
            layer[batch] = graph.spread(batch, np.concatenate((found, peers), axis=1), most)
            _link_back(graph, layer, batch)
            inside = int(batch[-1]) + 1
        graph.layers.append(layer)
    return graph


def _link_back(graph: Graph, layer: np.ndarray, batch: np.ndarray) -> None:
    """Links from the neighbours of new nodes back to them; where there are too many, neighbours are chosen anew."""
    most = layer.shape[1]
    other = layer[batch].ravel()
    own = np.repeat(batch, most)
    own, other = own[other >= 0], other[other >= 0]
    apart = graph.vectors[own] - graph.vectors[other]
    order = np.lexsort((np.einsum("ij,ij->i", apart, apart), other))
    own, other = own[order], other[order]
    touched, first, counts = np.unique(other, return_index=True, return_counts=True)
    place = np.arange(len(other)) - np.repeat(first, counts)
    # of many new ones, the nearest
    near = place < most
    added = np.full((len(touched), most), -1, np.int64)
    added[np.repeat(np.arange(len(touched)), counts)[near], place[near]] = own[near]
    # a new node may be linked to both ways already
    added[(added[:, :, None] == layer[touched][:, None, :]).any(axis=2)] = -1
    candidates = np.concatenate((layer[touched], added), axis=1)
    over = (candidates >= 0).sum(axis=1) > most
    packed = np.take_along_axis(candidates, np.argsort(candidates < 0, axis=1, kind="stable"), 1)[:, :most]
    packed[over] = graph.spread(touched[over], candidates[over], most)
    layer[touched] = packed


_INDEX = "dim int, shard long, vectors binary, layers array<binary>, ids array<array<long>>"


def _build_shard(key: tuple, table: pa.Table) -> pa.Table:
    """The distinct vectors of a shard to one row that holds its graph as flat arrays."""
    dim = key[0].as_py()
    flat = np.concatenate([np.asarray(c.flatten(), np.float64) for c in table.column("embedding").chunks])
    vectors = flat.reshape(-1, dim)
    # the same order for any partitioning, and unlike that of the values
    order = np.argsort(np.asarray(table.column("place")), kind="stable")
    vectors, ids = vectors[order], table.column("ids").take(pa.array(order))
    graph = build(_scaled(vectors)[0])
    return pa.table(
        {
            "dim": pa.array([dim], pa.int32()),
            "shard": pa.array([key[1].as_py()], pa.int64()),
            "vectors": pa.array([vectors.tobytes()], pa.binary()),
            "layers": pa.array([[layer.astype(np.int32).tobytes() for layer in graph.layers]], pa.list_(pa.binary())),
            "ids": pa.array([ids.to_pylist()], pa.list_(pa.list_(pa.int64()))),
        }
    )


def _scaled(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """Vectors over the largest component, in single precision unless their magnitudes differ too much for it, and that component."""
    most = np.abs(vectors).max(axis=1)
    scale = float(most.max())
    return (vectors / scale).astype(np.float32 if scale < SINGLE_SPREAD * most.min() else np.float64), scale


def _loaded(dim: int, vectors: bytes, layers: list[bytes]) -> tuple[np.ndarray, Graph, float]:
    """A shard's vectors in double precision, its graph, and the scale of the graph's vectors."""
    whole = np.frombuffer(vectors, np.float64).reshape(-1, dim)
    scaled, scale = _scaled(whole)
    shaped = []
    sizes = [len(whole)]
    while len(sizes) < len(layers):
        sizes.append(-(-sizes[-1] // LINKS))
    for size, raw in zip(reversed(sizes), layers, strict=True):
        shaped.append(np.frombuffer(raw, np.int32).reshape(size, -1).astype(np.int64))
    return whole, Graph(scaled, np.einsum("ij,ij->i", scaled, scaled), shaped), scale


def _search(k: int, width: int):
    """Rows of a shard with a block of queries to the nearest ``k`` rows of the shard for each query."""
    schema = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def nearest(whole: np.ndarray, ids: list[list[int]], query_id: int, query: np.ndarray, found: np.ndarray) -> list[tuple[float, int]]:
        apart = whole[found] - query
        score = np.sqrt((apart * apart).sum(axis=1))
        rows = []
        for at, s in zip(found.tolist(), score.tolist(), strict=True):
            same = list(ids[at])
            if s == 0 and query_id in same:
                same.remove(query_id)
            rows += [(s, i) for i in same]
        return sorted(rows)[:k]

    def run(frames):
        for batch in frames:
            for dim, vectors, layers, ids, block in zip(*[batch.column(c).to_pylist() for c in range(5)], strict=True):
                whole, graph, scale = _loaded(dim, vectors, layers)
                queries = np.array([b["embedding"] for b in block], np.float64)
                found = graph.search(queries / scale, max(width, k + 1))[:, : 3 * (k + 1)]
                out: list[list] = [[] for _ in schema]
                for b, query, near in zip(block, queries, found, strict=True):
                    for score, vec_id in nearest(whole, ids, b["query_id"], query, near[near >= 0]):
                        for column, x in zip(out, (b["q"], b["query_id"], vec_id, score), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def usable(vector: Column) -> Column:
    """True for vectors that have a component other than zero and none that is NULL or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def index(vectors: DataFrame, k: int, key: str, vector: str, shard_rows: int) -> DataFrame:
    """(dim, shard, vectors, layers, ids): a row per shard that has vectors; ``ids`` are the ``k + 1`` smallest keys of each distinct vector."""
    spark = vectors.sparkSession
    by_key = Window.partitionBy("embedding").orderBy("vec_id")
    least = vectors.withColumn("__rank", F.row_number().over(by_key)).filter(F.col("__rank") <= k + 1)
    distinct = freeze(least.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    distinct = distinct.withColumn("dim", F.size("embedding"))
    sizes = freeze(distinct.groupBy("dim").agg(F.expr(f"(count(1) + {shard_rows - 1}) div {shard_rows}").alias("shards")))
    total = sizes.agg(F.sum("shards")).first()[0] or 1
    dealt = distinct.join(broadcast_if_small(sizes), "dim").select(
        "dim", F.pmod(F.xxhash64("embedding"), F.col("shards")).alias("shard"), F.xxhash64("embedding", F.lit(1)).alias("place"), "embedding", "ids"
    )
    parts = max(2 * total, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return freeze(dealt.repartition(parts, "dim", "shard").groupBy("dim", "shard").applyInArrow(_build_shard, _INDEX))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
    shard_rows: int = SHARD_ROWS, width: int = SEARCH_WIDTH,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row that ``is_query``, itself excepted.

    ``score`` is the Euclidean distance in double precision; equal scores are ranked by key. Vectors that are
    NULL, empty, all zero or hold a NULL or non-finite component take no part, neither do rows without a key; vectors of another
    length are not compared. Of a vector that many rows share, one stands in the graph with its smallest keys, so copies crowd out
    nothing. Equal rows are one query, and candidates each; rows of one key with different vectors are queries of their own. With
    fewer candidates all are returned. An empty table gives no rows; other columns are neither read nor returned.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"), is_query.alias("asked"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    shards = index(rows.drop("asked"), k, key, vector, shard_rows)

    asked = rows.filter("asked").select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    asked = freeze(asked.withColumns({"q": F.monotonically_increasing_id(), "dim": F.size("embedding")}))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    packed = asked.groupBy("dim", F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct("q", "query_id", "embedding")).alias("queries")
    )
    counts = shards.groupBy("dim").agg((F.max("shard") + 1).alias("shards"))
    # the block of queries goes to every shard of its length
    sent = packed.join(broadcast_if_small(counts), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    met = shards.join(sent.drop("shards"), ["dim", "shard"])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * blocks)
    met = met.repartition(parts, "dim", "shard", "block").select("dim", "vectors", "layers", "ids", "queries")
    found = met.mapInArrow(_search(k, width), "q long, query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
