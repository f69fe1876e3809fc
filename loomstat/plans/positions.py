"""Ordered work on keys of any size.

A plain window puts all rows of a key into one task. That is right for most keys
and wrong for a key that holds a third of the table, or for a frame without a key.
Every ordered operator therefore splits its input:

* keys with at most ``max_group_rows`` rows take one keyed window, one shuffle;
* larger keys are cut into ranges of (key, order) at fixed borders. Each row's position
  follows from its place inside the range plus the sizes of the ranges before. Blocks
  of equally many positions then go to separate tasks, with copies of the few
  neighbouring rows that a window frame needs.

The borders are constants of the plan. Every pass over the rows therefore cuts them alike,
so rows need not be written between passes, and a pass reads the columns that it uses.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.plans.keys import attach, cols, keyed
from loomstat.plans.limits import broadcast_if_small, max_group_rows, shuffle_partitions
from loomstat.plans.scratch import freeze

POS, BLOCK, OWN = "__pos", "__block", "__own"
# rows of the sample per range; a range holds twice its share with a chance below one in a thousand
_SAMPLED = 64


@dataclass(frozen=True)
class Split:
    """Rows of ordinary keys and rows of oversized keys; either may be absent."""

    cold: DataFrame | None
    hot: DataFrame | None
    hot_rows: int = 0


def split_hot(
    df: DataFrame, by: Sequence[str], max_rows: int | None = None, measure: Column | None = None
) -> Split:
    """Separate the keys whose size exceeds ``max_rows``.

    ``measure`` is the size of a key (default: its row count). The job reads only
    the key columns and is combined map-side. At most ``rows / max_rows`` keys can be
    oversized, and their list is broadcast only when measured to be small.
    """
    limit = max_rows or max_group_rows(df.sparkSession)
    if not by:
        return Split(None, df, df.count())
    size = F.count(F.lit(1)) if measure is None else measure
    oversized = df.groupBy(*cols(by)).agg(size.alias("__size")).filter(F.col("__size") > limit)
    found = oversized.agg(F.sum("__size")).first()[0]
    if not found:
        return Split(df, None)
    table = broadcast_if_small(freeze(oversized.select(*cols(by))))
    return Split(attach(df, table, by, "left_anti"), attach(df, table, by, "left_semi"), found)


def union(parts: Sequence[DataFrame | None]) -> DataFrame:
    present = [p for p in parts if p is not None]
    out = present[0]
    for part in present[1:]:
        out = out.unionByName(part)
    return out


def _range_count(df: DataFrame, rows: int, limit: int) -> int:
    """All cores are used once they have a thousand rows each; no range is planned above ``limit`` rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(min(cores, rows // 1000), -(-rows // limit), 2)


def fixed_borders(df: DataFrame, sort: Sequence[Column], rows: int, parts: int) -> tuple[Column, int]:
    """Borders of about ``parts`` ranges of ``sort`` as an ascending array constant, and their number.

    They come from a sample of some 64 rows per range, read from the ``sort`` columns alone. Any ascending
    array cuts the rows correctly, so the sample decides how even the ranges are, never which rows
    they hold together.
    """
    at = df.select(F.struct(*[c.alias(f"f{i}") for i, c in enumerate(sort)]).alias("at"))
    share = min(1.0, _SAMPLED * parts / max(rows, 1))
    found = (at if share == 1.0 else at.sample(share, seed=parts)).agg(F.array_sort(F.collect_list("at")).alias("s"))
    every = F.greatest(F.floor(F.size("s") / parts), F.lit(1))
    found = found.select(F.filter("s", lambda _, i: (i + 1) % every == 0).alias("s"))
    styles = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    row = found.select(F.size("s").alias("n"), F.to_json("s", styles).alias("text")).first()
    kind = T.ArrayType(at.schema["at"].dataType)
    return F.sort_array(F.from_json(F.lit(row["text"]), kind, styles)), row["n"]


def range_of(sort: Sequence[Column], borders: Column, n: int) -> Column:
    """How many of the ``n`` ascending borders a row is not below, by binary search."""
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(max(n.bit_length(), 1)))])
    here = F.struct(*[c.alias(f"f{i}") for i, c in enumerate(sort)])

    def halve(state: Column, step: Column) -> Column:
        further = state["n"] + step
        taken = F.when(F.get(borders, further - 1) <= state["at"], further).otherwise(state["n"])
        return F.struct(taken.alias("n"), state["at"].alias("at"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("n"), here.alias("at")), halve, lambda state: state["n"])


def range_positions(
    df: DataFrame, by: Sequence[str], order: Sequence[str], rows: int, limit: int, ties: Sequence[str] = ()
) -> DataFrame:
    """Add ``__pos``, the 0-based position within the key, without gathering a key.

    Rows are ordered by ``order`` and then ``ties``; rows that agree in both take their positions in any
    way, which may differ from one use of the frame to the next. Two passes over the key and order columns find
    borders and the exact number of rows per key and range; the rows themselves are shuffled once,
    by key and range, and never written. The table of range sizes has at most (oversized keys + ranges)
    rows. Rows that agree in ``order`` share a range.
    """
    sort = cols([*by, *order])
    borders, n = fixed_borders(df, sort, rows, _range_count(df, rows, limit))
    ranged = df.withColumn("__range", range_of(sort, borders, n))
    sizes = ranged.groupBy(*cols(by), "__range").agg(F.count(F.lit(1)).alias("__rows"))
    before = keyed(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start")
    starts = freeze(sizes.select(*cols(by), "__range", start))
    inside = Window.partitionBy(*cols(by), "__range").orderBy(*cols([*order, *ties]))
    numbered = ranged.withColumn("__at", F.row_number().over(inside))
    numbered = attach(numbered, broadcast_if_small(starts), [*by, "__range"])
    return numbered.withColumn(POS, F.col("__start") + F.col("__at") - 1).drop("__range", "__at", "__start")


def positions(
    df: DataFrame, by: Sequence[str], order: Sequence[str], max_rows: int | None = None
) -> DataFrame:
    """Add ``__pos`` for keys of any size."""
    limit = max_rows or max_group_rows(df.sparkSession)
    split = split_hot(df, by, limit)
    cold = hot = None
    if split.cold is not None:
        numbering = keyed(by).orderBy(*cols(order))
        cold = split.cold.withColumn(POS, F.row_number().over(numbering).cast("long") - 1)
    if split.hot is not None:
        hot = range_positions(split.hot, by, order, split.hot_rows, limit)
    return union([cold, hot])


def windowed(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    make: Callable[[WindowSpec], Mapping[str, Column]],
    before: int,
    after: int = 0,
    max_rows: int | None = None,
) -> DataFrame:
    """Add window columns whose frame reaches ``before`` rows back and ``after`` ahead.

    ``make`` gets an ordered window specification and sets the frame itself.
    """
    limit = max_rows or max_group_rows(df.sparkSession)
    split = split_hot(df, by, limit)
    cold = hot = None
    if split.cold is not None:
        cold = split.cold.withColumns(dict(make(keyed(by).orderBy(*cols(order)))))
    if split.hot is not None:
        rows = range_positions(split.hot, by, order, split.hot_rows, limit)
        hot = over_blocks(rows, by, make, before, after, limit).drop(POS)
    return union([cold, hot])


def over_blocks(
    rows: DataFrame, by: Sequence[str], make: Callable[[WindowSpec], Mapping[str, Column]],
    before: int, after: int, limit: int,
) -> DataFrame:
    """As :func:`windowed`, on rows that carry ``__pos``: blocks with copies of their neighbours."""
    size = max(limit, before + 1, after + 1)
    at = F.pmod(POS, F.lit(size))
    block = F.floor(F.col(POS) / size).cast("long")
    targets = F.array_compact(
        F.array(
            block,
            F.when(at >= size - before, block + 1),
            F.when((at < after) & (block > 0), block - 1),
        )
    )
    copies = rows.withColumn(OWN, block).withColumn(BLOCK, F.explode(targets))
    spec = Window.partitionBy(*cols(by), BLOCK).orderBy(POS)
    return copies.withColumns(dict(make(spec))).filter(F.col(BLOCK) == F.col(OWN)).drop(BLOCK, OWN)


def cold_total(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, cum: str, total: str | None
) -> DataFrame:
    """Running sum where every key fits into one task."""
    v = cols([value])[0]
    upto = keyed(by).orderBy(*cols(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {cum: F.sum(v).over(upto)}
    if total:
        added[total] = F.sum(v).over(keyed(by))
    return df.withColumns(added)


def hot_total(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, cum: str, total: str | None,
    rows: int, size: int,
) -> DataFrame:
    """Running sum in blocks of ``size`` positions plus the sums of the blocks before."""
    v = cols([value])[0]
    # the rows are read for the sums and again for the output: equal values may change places, others not
    placed = range_positions(df, by, order, rows, size, ties=[value])
    placed = placed.withColumn(BLOCK, F.floor(F.col(POS) / size).cast("long"))
    sums = placed.groupBy(*cols(by), BLOCK).agg(F.sum(v).alias("__sum"))
    earlier = keyed(by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *cols(by),
        BLOCK,
        F.sum("__sum").over(earlier).alias("__base"),
        F.sum("__sum").over(keyed(by)).alias("__all"),
    )
    inside = Window.partitionBy(*cols(by), BLOCK).orderBy(POS)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = attach(
        placed.withColumn("__in", F.sum(v).over(inside)), broadcast_if_small(freeze(starts)), [*by, BLOCK]
    )
    # as in one window over the key: NULL until the first value, later NULLs add nothing
    both = F.coalesce("__base", F.lit(0)) + F.coalesce("__in", F.lit(0))
    out = out.withColumn(cum, F.when(F.col("__base").isNotNull() | F.col("__in").isNotNull(), both))
    if total:
        out = out.withColumn(total, F.col("__all"))
    return out.drop(POS, BLOCK, "__in", "__base", "__all")


def running_total(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: str,
    cum: str = "__cum",
    total: str | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Add the inclusive running sum of ``value``, and the key's total when asked."""
    limit = max_rows or max_group_rows(df.sparkSession)
    split = split_hot(df, by, limit)
    cold = hot = None
    if split.cold is not None:
        cold = cold_total(split.cold, by, order, value, cum, total)
    if split.hot is not None:
        hot = hot_total(split.hot, by, order, value, cum, total, split.hot_rows, limit)
    return union([cold, hot])


def expand(df: DataFrame, count: str, index: str = "i", spread: bool = True) -> DataFrame:
    """Repeat each row ``count`` times with an index from 0; rows with count < 1 vanish.

    Long rows are first cut into chunks, and the chunks are spread over the cluster, so
    one row with a huge count is not expanded by one task.
    """
    chunk = 65_536
    n = cols([count])[0]
    chunks = df.filter(n > 0).withColumn(
        "__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / chunk).cast("long")))
    )
    if spread:
        keys = [c for c, t in df.dtypes if not t.startswith("map")]
        chunks = chunks.repartition(shuffle_partitions(df.sparkSession), *cols(keys), "__chunk")
    first = F.col("__chunk") * chunk
    last = F.least(first + chunk, n.cast("long")) - 1
    return chunks.withColumn(index, F.explode(F.sequence(first, last))).drop("__chunk")
