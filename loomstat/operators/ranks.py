"""Exact order statistics for keys of any size.

Equal values are collapsed into (value, count) first. A value then owns the ranks
``[cum - count, cum)``, so any rank is found by comparison with the running count,
and neither a heavy value nor a heavy key ends up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions.text import valid
from loomstat.plans.keys import as_list, cols, q
from loomstat.plans.limits import max_group_rows
from loomstat.plans.positions import cold_total, hot_total, split_hot, union


def _ranked(df: DataFrame, by: Sequence[str], column: str, max_rows: int | None) -> DataFrame:
    """Columns ``by``, ``v``, first rank ``lo``, end rank ``hi``, key size ``n``."""
    limit = max_rows or max_group_rows(df.sparkSession)
    values = df.filter(valid(column)).select(*cols(by), q(column).cast("double").alias("v"))
    # after the collapse a key is as large as its number of distinct values
    split = split_hot(values, by, limit, F.approx_count_distinct("v"))

    def collapse(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*cols(by), "v").agg(F.count(F.lit(1)).alias("c"))

    cold = hot = None
    if split.cold is not None:
        cold = cold_total(collapse(split.cold), by, ["v"], "c", "hi", "n")
    if split.hot is not None:
        hot = hot_total(collapse(split.hot), by, ["v"], "c", "hi", "n", split.hot_rows, limit)
    return union([cold, hot]).select(*cols(by), "v", (F.col("hi") - F.col("c")).alias("lo"), "hi", "n")


def _at(rank: Column) -> Column:
    """Value at a 0-based rank, as an aggregate over ranked rows."""
    return F.max(F.when((F.col("lo") <= rank) & (rank < F.col("hi")), F.col("v")))


def central_interval(
    df: DataFrame,
    by: str | Sequence[str] | None,
    column: str,
    x: float = 0.95,
    max_rows: int | None = None,
) -> DataFrame:
    """Bounds ``lower``, ``upper`` of the values left after dropping r of n.

    r is the largest number with (n - r) / n >= x. Half of them goes from each end; an
    odd one goes from the end with the smaller gap, on a tie from the right.
    """
    if not 0 < x <= 1:
        raise ValueError("x must be in (0, 1]")
    by = as_list(by)
    n = F.col("n")
    guess = F.floor(n * (1 - F.lit(float(x))))
    r = (
        F.when((n - guess - 1) / n >= x, guess + 1)
        .when((n - guess) / n < x, guess - 1)
        .otherwise(guess)
    )
    h = F.floor(r / 2)
    picks = _ranked(df, by, column, max_rows).groupBy(*cols(by)).agg(
        F.max(n).alias("n"),
        F.max(r).alias("dropped"),
        _at(h).alias("a0"),
        _at(h + 1).alias("a1"),
        _at(n - h - 2).alias("b1"),
        _at(n - h - 1).alias("b0"),
    )
    odd = F.col("dropped") % 2 == 1
    left_is_smaller = F.col("a1") - F.col("a0") < F.col("b0") - F.col("b1")
    return picks.select(
        *cols(by),
        F.when(odd & left_is_smaller, F.col("a1")).otherwise(F.col("a0")).alias("lower"),
        F.when(odd & ~left_is_smaller, F.col("b1")).otherwise(F.col("b0")).alias("upper"),
        "n",
        "dropped",
    ).filter(F.col("n") > 0)


def percentiles(
    df: DataFrame,
    by: str | Sequence[str] | None,
    column: str,
    ps: Sequence[float],
    max_rows: int | None = None,
) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per key and ``p`` in [0, 1]."""
    if not all(0 <= p <= 1 for p in ps):
        raise ValueError("percentiles are given as shares in [0, 1]")
    by = as_list(by)
    n = F.col("n")
    picks = []
    for i, p in enumerate(ps):
        at = F.lit(float(p)) * (n - 1)
        picks += [
            _at(F.floor(at)).alias(f"low{i}"),
            _at(F.ceil(at)).alias(f"high{i}"),
            F.max(at - F.floor(at)).alias(f"part{i}"),
        ]
    wide = _ranked(df, by, column, max_rows).groupBy(*cols(by)).agg(F.max(n).alias("n"), *picks)
    items = [
        F.struct(
            F.lit(float(p)).alias("p"),
            (F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * F.col(f"part{i}")).alias("value"),
        )
        for i, p in enumerate(ps)
    ]
    return wide.filter(n > 0).select(*cols(by), F.inline(F.array(*items)))
