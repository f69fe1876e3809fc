"""Rolling windows, runs of true values and waterfalls over ordered series."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loomstat.functions.text import nan_to_null
from loomstat.plans.keys import as_list, attach, cols, keyed, q
from loomstat.plans.limits import broadcast_if_small, max_group_rows
from loomstat.plans.positions import (
    BLOCK,
    POS,
    over_blocks,
    range_positions,
    running_total,
    split_hot,
    union,
    windowed,
)


# frames up to this many rows are summed anew for each row; longer ones are put together from two parts
SHORT = 64


def _moments(value: Column, spec: WindowSpec) -> Column:
    """Number, mean and sum of squared deviations over a frame that only grows."""
    frame = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.count(value).over(frame)
    return F.struct(
        n.alias("n"), F.avg(value).over(frame).alias("mean"), (F.var_pop(value).over(frame) * n).alias("m2")
    )


def _merged(a: Column, b: Column) -> Column:
    """Moments of two parts together; either may be NULL or without values."""
    n = a["n"] + b["n"]
    shift = b["mean"] - a["mean"]
    both = F.struct(
        n.alias("n"), (a["mean"] + shift * b["n"] / n).alias("mean"),
        (a["m2"] + b["m2"] + shift * shift * a["n"] * b["n"] / n).alias("m2"),
    )
    return F.when(F.coalesce(a["n"], F.lit(0)) == 0, b).when(F.coalesce(b["n"], F.lit(0)) == 0, a).otherwise(both)


def _parts(rows: DataFrame, by: Sequence[str], names: Sequence[str], k: int) -> DataFrame:
    """Moments from the start of each aligned block of k rows to the row, and from the row to its end."""
    block = F.floor(F.col(POS) / k)
    ahead = Window.partitionBy(*cols(by), block).orderBy(POS)
    behind = Window.partitionBy(*cols(by), block).orderBy(F.col(POS).desc())
    added = {}
    for i, name in enumerate(names):
        value = nan_to_null(q(name).cast("double"))
        added[f"__p{i}"], added[f"__s{i}"] = _moments(value, ahead), _moments(value, behind)
    return rows.withColumns(added)


def _long_rolling(df, by, order, names, k, result, suffix, max_rows) -> DataFrame:
    """Rolling moments at a cost that does not depend on k.

    A window of k rows is the end of one block of k rows and the start of the next. Both grow row by row,
    and nothing is subtracted, so no precision is lost.
    """
    limit = max_rows or max_group_rows(df.sparkSession)

    def make(spec: WindowSpec) -> Mapping[str, Column]:
        out = {}
        whole = F.col(POS) % k == k - 1
        for i, name in enumerate(names):
            start, end = F.col(f"__p{i}"), F.lag(f"__s{i}", k - 1).over(spec)
            m = F.when(whole, start).otherwise(_merged(end, start))
            out[f"{name}_{suffix}"] = F.when((F.col(POS) >= k - 1) & (m["n"] >= k), result(m))
        return out

    split = split_hot(df, by, limit)
    cold = hot = None
    if split.cold is not None:
        numbering = keyed(by).orderBy(*cols(order))
        rows = split.cold.withColumn(POS, F.row_number().over(numbering).cast("long") - 1)
        cold = _parts(rows, by, names, k).withColumns(dict(make(keyed(by).orderBy(POS))))
    if split.hot is not None:
        rows = range_positions(split.hot, by, order, split.hot_rows, limit)
        hot = over_blocks(_parts(rows, by, names, k), by, make, k - 1, 0, limit)
    helpers = [f"__{side}{i}" for i in range(len(names)) for side in "ps"]
    return union([cold, hot]).drop(POS, *helpers)


def _rolling(
    df: DataFrame,
    by: str | Sequence[str] | None,
    order: str | Sequence[str],
    columns: str | Sequence[str],
    k: int,
    function: Callable[[Column], Column],
    result: Callable[[Column], Column],
    suffix: str,
    max_rows: int | None,
) -> DataFrame:
    """``function`` aggregates a short frame; ``result`` reads the same off the moments of a long one."""
    if k < 1:
        raise ValueError("the window needs at least one row")
    names = as_list(columns)
    if k > SHORT:
        return _long_rolling(df, as_list(by), as_list(order), names, k, result, suffix, max_rows)

    def make(spec: WindowSpec) -> Mapping[str, Column]:
        frame = spec.rowsBetween(-(k - 1), 0)
        out = {}
        for name in names:
            value = nan_to_null(q(name).cast("double"))
            full = F.count(value).over(frame) >= k
            out[f"{name}_{suffix}"] = F.when(full, function(value).over(frame))
        return out

    return windowed(df, as_list(by), as_list(order), make, before=k - 1, max_rows=max_rows)


def moving_avg(df, by, order, columns, k, max_rows=None) -> DataFrame:
    """Trailing mean of k rows; NULL unless all k values are valid.

    Adds ``<column>_avg`` for each column. ``by`` may be empty: one series of any length.
    """
    return _rolling(df, by, order, columns, k, F.avg, lambda m: m["mean"], "avg", max_rows)


def moving_sum(df, by, order, columns, k, max_rows=None) -> DataFrame:
    """Trailing sum of k rows, as :func:`moving_avg`; adds ``<column>_sum``."""
    return _rolling(df, by, order, columns, k, F.sum, lambda m: m["mean"] * m["n"], "sum", max_rows)


def moving_std(df, by, order, columns, k, max_rows=None) -> DataFrame:
    """Trailing sample deviation of k rows; adds ``<column>_std``, NULL for k = 1."""
    return _rolling(
        df, by, order, columns, k, F.stddev_samp, lambda m: F.sqrt(m["m2"] / (m["n"] - 1)), "std", max_rows
    )


def _runs(rows: DataFrame, within: Sequence[str], flag: str) -> DataFrame:
    """Runs of true inside each part: ``start``, ``end`` positions."""
    spec = Window.partitionBy(*cols(within)).orderBy(POS)
    rank = F.row_number().over(spec)
    true_rows = rows.filter(q(flag)).withColumn("__island", F.col(POS) - rank)
    return true_rows.groupBy(*cols(within), "__island").agg(
        F.min(POS).alias("start"), F.max(POS).alias("end")
    )


def true_runs(
    df: DataFrame,
    by: str | Sequence[str] | None,
    order: str | Sequence[str],
    flag: str,
    partial: bool = False,
    max_rows: int | None = None,
) -> DataFrame:
    """Maximal runs of true as inclusive 0-based positions ``start``, ``end``.

    Without ``partial`` a run that touches either end of its series is left out. A NULL
    flag counts as false.
    """
    by, order = as_list(by), as_list(order)
    limit = max_rows or max_group_rows(df.sparkSession)
    slim = df.select(*cols(by), *cols(order), F.coalesce(q(flag), F.lit(False)).alias("__flag"))
    split = split_hot(slim, by, limit)
    cold = hot = None
    if split.cold is not None:
        spec = keyed(by).orderBy(*cols(order))
        rows = split.cold.withColumns(
            {
                POS: F.row_number().over(spec).cast("long") - 1,
                "__n": F.count(F.lit(1)).over(keyed(by)),
            }
        )
        cold = _runs(rows, [*by, "__n"], "__flag").drop("__island")
    if split.hot is not None:
        # runs per block first; only runs at block borders can belong together
        rows = range_positions(split.hot, by, order, split.hot_rows, limit)
        rows = rows.withColumn(BLOCK, F.floor(F.col(POS) / limit).cast("long"))
        sizes = rows.groupBy(*cols(by)).agg(F.count(F.lit(1)).alias("__n"))
        pieces = _runs(rows, [*by, BLOCK], "__flag").drop("__island")
        at_border = (F.col("start") % limit == 0) | (F.col("end") % limit == limit - 1)
        border = pieces.filter(at_border)
        spec = keyed(by).orderBy("start")
        fresh = F.col("start") != F.lag("end").over(spec) + 1
        border = border.withColumn("__new", F.coalesce(fresh, F.lit(True)).cast("int"))
        border = border.withColumn("__run", F.sum("__new").over(spec))
        joined = border.groupBy(*cols(by), "__run").agg(
            F.min("start").alias("start"), F.max("end").alias("end")
        )
        runs = pieces.filter(~at_border).drop(BLOCK).unionByName(joined.drop("__run"))
        hot = attach(runs, broadcast_if_small(sizes), by)
    out = union([cold, hot])
    if not partial:
        out = out.filter((F.col("start") > 0) & (F.col("end") < F.col("__n") - 1))
    return out.select(*cols(by), "start", "end")


def waterfall(
    df: DataFrame,
    by: str | Sequence[str] | None,
    order: str | Sequence[str],
    delta: str,
    base: float | str = 0.0,
    max_rows: int | None = None,
) -> DataFrame:
    """Segments (``x0``, ``x1``) of a running total from ``base``, their sign and label.

    A missing delta (NULL or NaN) adds nothing: the total goes on behind it, and its own ``x0``, sign and
    label are NULL. The total is NULL as long as no delta of the series is known.
    """
    start = q(base) if isinstance(base, str) else F.lit(float(base))
    d = q(delta)
    if dict(df.dtypes)[delta] in ("double", "float"):
        df = df.withColumn(delta, nan_to_null(d))
    out = running_total(df, as_list(by), as_list(order), delta, "__run", max_rows=max_rows)
    return (
        out.withColumn("x1", start + F.col("__run"))
        .withColumn("x0", F.col("x1") - d)
        .withColumn("sign", F.when(d >= 0, "positive").when(d < 0, "negative"))
        .withColumn("label", F.format_number(d, 2))
        .drop("__run")
    )
