"""Set partitions into m blocks, one per row, without enumerating in sequence.

The partitions of n items are numbered 0 .. S(n, m) - 1. A number is decoded on its own:
at every item, the counts of possible completions say which block the number falls into.
So the numbers are spread over the cluster and no row depends on another one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from loomstat.plans.keys import as_list, cols, keyed, q
from loomstat.plans.limits import shuffle_partitions
from loomstat.plans.positions import expand
from loomstat.plans.scratch import freeze

_MAX = (1 << 63) - 1
# up to this many assignments are decoded once and broadcast
FEW_ASSIGNMENTS = 100_000
AGGREGATES = ("sum", "min", "max", "mean")
# partitions that one task compares at once
CHUNK = 262_144
# a table of all subsets holds eight bytes a subset
MAX_SUBSET_ITEMS = 20


def completions(items: int, m: int) -> list[list[int]]:
    """``table[left][used]``: ways to place the remaining items so that m blocks are used."""
    table = [[1 if used == m else 0 for used in range(m + 2)]]
    for _ in range(items):
        last = table[-1]
        row = [used * last[used] + last[used + 1] for used in range(m + 1)] + [0]
        table.append(row)
    return table


def _count(items: int, m: int, orders: int) -> int:
    total = completions(items, m)[items][0] * orders
    if total > _MAX:
        raise ValueError("more rows than a 64-bit number can count")
    return total


def _blocks_of(rank: Column, n: Column, table: Column, m: int) -> Column:
    """Block number of each item, blocks numbered by their first item."""

    def place(state: Column, left: Column) -> Column:
        same = F.element_at(F.element_at(table, left + 1), state["used"] + 1)
        old = state["rank"] < same * state["used"]
        step = F.greatest(same, F.lit(1).cast("long"))
        block = F.when(old, _div(state["rank"], step)).otherwise(state["used"])
        return F.struct(
            F.when(old, F.pmod(state["rank"], step)).otherwise(state["rank"] - same * state["used"]).alias("rank"),
            (state["used"] + F.when(old, 0).otherwise(1)).cast("int").alias("used"),
            F.array_append(state["blocks"], block.cast("int")).alias("blocks"),
        )

    begin = F.struct(
        rank.cast("long").alias("rank"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("blocks")
    )
    lefts = F.sequence(n - 1, F.lit(0), F.lit(-1))
    return F.aggregate(lefts, begin, place, lambda state: state["blocks"])


def _div(a: Column, b: Column) -> Column:
    """Whole-number quotient of longs."""
    return F.call_function("div", a, b)


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also when ``use`` repeats it in a lambda."""
    return F.transform(F.array(value), use)[0]


def _order_of(rank: Column, m: int) -> Column:
    """The permutation of 0 .. m-1 with the given number, by repeatedly taking one of the rest."""

    def take(state: Column, i: Column) -> Column:
        size = F.size(state["rest"])
        at = F.pmod(state["rank"], size).cast("int") + 1
        return F.struct(
            _div(state["rank"], size.cast("long")).alias("rank"),
            F.concat(
                F.slice(state["rest"], F.lit(1), at - 1), F.slice(state["rest"], at + 1, size)
            ).alias("rest"),
            F.array_append(state["out"], F.element_at(state["rest"], at)).alias("out"),
        )

    numbers = F.sequence(F.lit(0), F.lit(m - 1))
    begin = F.struct(rank.alias("rank"), numbers.alias("rest"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(m)), begin, take, lambda state: state["out"])


def _assignment(rank: Column, n: Column, m: int, max_items: int, ordered: bool) -> Column:
    """Block number of each of n items in the partition with the given number."""
    table = F.array(*[F.array(*[F.lit(c).cast("long") for c in row]) for row in completions(max_items, m)])
    if not ordered:
        return _blocks_of(rank, n, table, m)
    orders = F.lit(math.factorial(m)).cast("long")
    blocks = _blocks_of(_div(rank, orders), n, table, m)
    return _with(
        _order_of(F.pmod(rank, orders), m),
        lambda order: F.transform(blocks, lambda b: F.element_at(order, b + 1)),
    )


def partitions_of(
    df: DataFrame, items: str, m: int, max_items: int, ordered: bool = False, name: str = "blocks"
) -> DataFrame:
    """Every partition of each row's ``items`` array into exactly m non-empty blocks.

    Adds ``rank`` and ``blocks`` (array of arrays, ordered by first item). ``ordered`` gives
    every ordering of the blocks instead. A row with fewer than m items gives no rows; one
    with more than ``max_items`` is an error.

    While all assignments for up to ``max_items`` items are few (a number known from the
    arguments), they are decoded once and broadcast; else every row decodes its own, and
    long rows are spread over tasks.
    """
    if m < 1:
        raise ValueError("at least one block")
    orders = math.factorial(m) if ordered else 1
    sizes = [_count(i, m, orders) if i else 0 for i in range(max_items + 1)]
    n = F.size(q(items))
    too_long = F.raise_error(F.lit(f"more than {max_items} items"))
    if sum(sizes) <= FEW_ASSIGNMENTS:
        counts = df.sparkSession.createDataFrame(list(enumerate(sizes)), "__n int, __total long")
        table = expand(counts, "__total", "rank", spread=False)
        table = table.select(
            "__n", "rank", _assignment(F.col("rank"), F.col("__n"), m, max_items, ordered).alias("__of")
        )
        wanted = F.when(n > max_items, too_long.cast("int")).otherwise(n)
        rows = df.join(F.broadcast(table), wanted == F.col("__n")).drop("__n")
    else:
        totals = F.array(*[F.lit(s).cast("long") for s in sizes])
        count = F.when(n > max_items, too_long.cast("long")).otherwise(
            F.element_at(totals, F.greatest(n, F.lit(0)) + 1)
        )
        rows = expand(df.withColumn("__total", count), "__total", "rank").drop("__total")
        rows = rows.withColumn("__of", _assignment(F.col("rank"), n, m, max_items, ordered))
    numbers = F.sequence(F.lit(0), F.lit(m - 1))

    def blocks_from(of: Column) -> Column:
        return F.transform(numbers, lambda b: F.filter(q(items), lambda x, i: F.element_at(of, i + 1) == b))

    return rows.withColumn(name, _with(F.col("__of"), blocks_from)).drop("__of")


def set_partitions(spark: SparkSession, items: Sequence, m: int) -> DataFrame:
    """All partitions of one list into m blocks: ``rank``, ``blocks``."""
    return _of_list(spark, items, m, False)


def ordered_partitions(spark: SparkSession, items: Sequence, m: int) -> DataFrame:
    """All orderings of the blocks of :func:`set_partitions`: ``rank``, ``blocks``."""
    return _of_list(spark, items, m, True)


def _per_category(df: DataFrame, by: Sequence[str], category: str, value: str, agg: str, max_items: int) -> DataFrame:
    """One row per key: ``__items``, its categories in order as (``__c``, ``__n``, ``__t``), with one more than allowed at most."""
    if agg not in AGGREGATES:
        raise ValueError(f"agg is one of {', '.join(AGGREGATES)}")
    v = q(value)
    total = {"min": F.min(v), "max": F.max(v)}.get(agg, F.sum(v))
    per = df.filter(q(category).isNotNull()).groupBy(*cols(by), q(category).alias("__c")).agg(
        F.count(v).alias("__n"), total.alias("__t")
    )
    # one more than allowed is enough for the error, so that no array grows beyond it
    number = F.row_number().over(keyed(by).orderBy("__c"))
    few = per.withColumn("__i", number).filter(F.col("__i") <= max_items + 1)
    return few.groupBy(*cols(by)).agg(F.array_sort(F.collect_list(F.struct("__c", "__n", "__t"))).alias("__items"))


def _block_score(block: Column, kind: DataType, agg: str) -> tuple[Column, Column]:
    """(number of values, aggregate) of a block of items; the aggregate is NULL without values."""
    n = F.aggregate(block["__n"], F.lit(0).cast("long"), lambda a, x: a + x)
    known = F.filter(block["__t"], lambda x: x.isNotNull())
    if agg in ("min", "max"):
        return n, {"min": F.array_min, "max": F.array_max}[agg](known)
    total = F.aggregate(known, F.lit(0).cast(kind), lambda a, x: (a + x).cast(kind))
    if agg == "mean":
        total = total.cast("double") / F.nullif(n, F.lit(0).cast("long"))
    return n, F.when(n > 0, total)


def score_partitions(
    df: DataFrame, by: str | Sequence[str] | None, category: str, value: str, m: int, max_items: int, agg: str = "sum"
) -> DataFrame:
    """Every grouping of a key's categories into m blocks with the aggregate of each block.

    Columns ``by``, ``rank`` (number of the partition), ``block`` (0-based), ``categories`` and, over the rows
    of the block's categories, ``n`` (values) and ``total`` (their ``agg``: sum, min, max or mean; NULL without values). Rows
    without a category are left out. The table is reduced to one row per category first, so the partitions multiply that
    small result only; a key with more than ``max_items`` categories is an error, one with fewer than m gives no rows.
    """
    by = as_list(by)
    items = _per_category(df, by, category, value, agg, max_items)
    kind = items.schema["__items"].dataType.elementType["__t"].dataType
    rows = partitions_of(items, "__items", m, max_items, name="__blocks")
    rows = rows.select(*cols(by), "rank", F.posexplode("__blocks").alias("block", "__b"))
    n, total = _block_score(F.col("__b"), kind, agg)
    return rows.select(*cols(by), "rank", "block", F.col("__b.__c").alias("categories"), n.alias("n"), total.alias("total"))


def _subset_scores(n: np.ndarray, t: np.ndarray, agg: str) -> np.ndarray:
    """The aggregate of every subset of items, by bit mask; each item doubles the table. NaN without values."""
    join = {"min": np.fmin, "max": np.fmax}.get(agg, np.add)
    empty = np.nan if agg in ("min", "max") else 0.0
    scores, counts = np.array([empty]), np.array([0], np.int64)
    for count, value in zip(n, t, strict=True):
        scores = np.concatenate((scores, join(scores, value if count else empty)))
        counts = np.concatenate((counts, counts + count))
    if agg == "mean":
        scores = scores / np.maximum(counts, 1)
    return np.where(counts > 0, scores, np.nan)


def _block_masks(ranks: np.ndarray, n: int, m: int) -> np.ndarray:
    """[block, rank]: the items of each block as bits, for many partition numbers at once."""
    table = completions(n, m)
    left, used = ranks.copy(), np.zeros(len(ranks), np.int64)
    masks = np.zeros((m, len(ranks)), np.int64)
    places = np.arange(len(ranks))
    for item in range(n):
        same = np.array(table[n - 1 - item], np.int64)[used]
        old = left < same * used
        step = np.maximum(same, 1)
        block = np.where(old, left // step, used)
        left = np.where(old, left % step, left - same * used)
        used = used + ~old
        masks[block, places] |= 1 << item
    return masks


def _best_of_chunks(m: int, agg: str, k: int):
    """Rows (id, rank, cost): the k partitions of a chunk of numbers whose block scores lie closest together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = np.array([x or 0 for x in row["n"]], np.int64)
                scores = _subset_scores(n, np.array([np.nan if x is None else x for x in row["t"]], np.float64), agg)
                ranks = np.arange(row["first"], row["last"] + 1)
                found = scores[_block_masks(ranks, len(n), m)]
                cost = found.max(axis=0) - found.min(axis=0)
                # a block without values has no score, so the partition has no cost
                usable = np.flatnonzero(~np.isnan(cost))
                if len(usable) > k:
                    limit = np.partition(cost[usable], k - 1)[k - 1]
                    usable = usable[cost[usable] <= limit]
                best = usable[np.lexsort((ranks[usable], cost[usable]))[:k]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["id"]] * len(best), pa.int64()), pa.array(ranks[best]), pa.array(cost[best])],
                    names=["__id", "rank", "cost"],
                )

    return run


def best_partitions(
    df: DataFrame, by: str | Sequence[str] | None, category: str, value: str, m: int, max_items: int, agg: str = "sum", k: int = 1
) -> DataFrame:
    """The ``k`` most even groupings of each key's categories into m blocks.

    A grouping's ``cost`` is the difference between the largest and the smallest ``agg`` (sum, min, max or mean) of
    its blocks; groupings with a block without values are left out. Columns ``by``, ``place`` (from 1; ties by ``rank``, the
    number of the partition), ``rank``, ``cost`` and ``blocks`` (arrays of categories). Rows without a category are left
    out; a key with more than ``max_items`` categories is an error, one with fewer than m gives no rows.

    A key's aggregates are taken once for every subset of its categories (``2 ** max_items`` numbers, 20 at most) and
    a partition looks its blocks up there. Numbers of partitions are dealt in chunks to all tasks, and a
    chunk passes on its k best alone.
    """
    if m < 1 or k < 1:
        raise ValueError("at least one block and one grouping")
    if max_items > MAX_SUBSET_ITEMS:
        raise ValueError(f"at most {MAX_SUBSET_ITEMS} items")
    by = as_list(by)
    items = _per_category(df, by, category, value, agg, max_items)
    items = freeze(items.withColumn("__id", F.monotonically_increasing_id()))
    size = F.size("__items")
    totals = F.array(*[F.lit(_count(i, m, 1) if i else 0).cast("long") for i in range(max_items + 1)])
    too_many = F.raise_error(F.lit(f"more than {max_items} items")).cast("long")
    count = F.when(size > max_items, too_many).otherwise(F.element_at(totals, size + 1))
    work = items.select(
        F.col("__id").alias("id"), F.col("__items.__n").alias("n"), F.col("__items.__t").cast("array<double>").alias("t"),
        count.alias("__total"),
    )
    chunks = work.filter("__total > 0").withColumn(
        "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__total") - 1, F.lit(CHUNK).cast("long")))
    )
    chunks = chunks.withColumn("last", F.least(F.col("first") + CHUNK, F.col("__total")) - 1).drop("__total")
    chunks = chunks.repartition(shuffle_partitions(df.sparkSession), "id", "first")
    found = chunks.mapInArrow(_best_of_chunks(m, agg, k), "__id long, rank long, cost double")
    place = F.row_number().over(keyed(["__id"]).orderBy("cost", "rank"))
    best = found.withColumn("place", place).filter(F.col("place") <= k)
    rows = best.join(items, "__id").withColumn("__of", _assignment(F.col("rank"), size, m, max_items, False))
    numbers = F.sequence(F.lit(0), F.lit(m - 1))

    def blocks_from(of: Column) -> Column:
        return F.transform(numbers, lambda b: F.filter(F.col("__items.__c"), lambda x, i: F.element_at(of, i + 1) == b))

    return rows.select(*cols(by), "place", "rank", "cost", _with(F.col("__of"), blocks_from).alias("blocks"))


def _of_list(spark: SparkSession, items: Sequence, m: int, ordered: bool) -> DataFrame:
    one = spark.range(1).select(F.array(*[F.lit(x) for x in items]).alias("items"))
    return partitions_of(one, "items", m, max(len(items), 1), ordered).select("rank", "blocks")
