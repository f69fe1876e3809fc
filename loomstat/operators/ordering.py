"""Sorting, first rows, explicit orders and stacking of samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.plans.keys import as_list, cols, q
from loomstat.plans.limits import broadcast_if_small


def sort_by(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Ascending with NaN and NULL last, by a range-partitioned sort."""
    return df.orderBy(*[c.asc_nulls_last() for c in cols(as_list(columns))])


def _permutation_size(df: DataFrame, column: str) -> int | None:
    """The number n of rows if ``column`` holds each of 0 .. n - 1 once, else None."""
    i = q(column)
    n, distinct, low, high = df.agg(F.count(F.lit(1)), F.count_distinct(i), F.min(i), F.max(i)).first()
    return n if distinct == n and (n == 0 or (low == 0 and high == n - 1)) else None


def order_by_list(df: DataFrame, index: str, positions: Sequence[int] | DataFrame) -> DataFrame:
    """Rows in the order in which ``positions`` lists their ``index`` value.

    Every position from 0 to n - 1 must be listed once, and the frame must have each of them
    once as ``index``. Adds ``rank``. An order as long as a table is itself a table, with the columns
    ``position`` and ``rank``, each from 0 to n - 1 once: both sides are checked by aggregates and joined, nothing of
    them reaches the driver.
    """
    if isinstance(positions, DataFrame):
        ranks = positions.select(F.col("position").cast("long").alias("__p"), F.col("rank").cast("long").alias("rank"))
        n = _permutation_size(ranks, "__p")
        valid = n is not None and _permutation_size(ranks, "rank") == n
    else:
        n = len(positions)
        valid = sorted(positions) == list(range(n))
        ranks = broadcast_if_small(df.sparkSession.createDataFrame([(p, r) for r, p in enumerate(positions)], "__p long, rank long")) if valid else None
    if not valid:
        raise ValueError("positions must list 0 .. n-1 once each")
    found = _permutation_size(df, index)
    if found is None:
        raise ValueError("rows must have each index from 0 to n - 1 once")
    if found != n:
        raise ValueError("positions and rows differ in number")
    return df.join(ranks, q(index) == F.col("__p")).drop("__p").orderBy("rank")


def first_per_group(df: DataFrame, by: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """First row per key by ``order``; an aggregate, so heavy keys combine map-side."""
    rest = [c for c in df.columns if c not in as_list(by)]
    key: Column = F.struct(*cols(as_list(order)))
    picked = df.groupBy(*cols(as_list(by))).agg(F.min_by(F.struct(*cols(rest)), key).alias("__row"))
    return picked.select(*cols(as_list(by)), *[F.col("__row").getField(c).alias(c) for c in rest]).select(
        *cols(df.columns)
    )


def stack_samples(samples: dict[str, DataFrame], label: str = "sample") -> DataFrame:
    """Samples below each other, each row with the label of its sample."""
    out = None
    for name, frame in samples.items():
        part = frame.withColumn(label, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
