"""Label codes, imputation and detection of non-numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.functions.text import nan_to_null, strict_double, try_double
from loomstat.plans.keys import as_list, cols, q
from loomstat.plans.limits import broadcast_if_small
from loomstat.plans.positions import POS, positions
from loomstat.plans.scratch import freeze


def text_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Columns with at least one value that is not a number; one job for all of them."""
    names = list(columns) if columns is not None else df.columns
    checks = [
        F.coalesce(F.bool_or(q(n).isNotNull() & try_double(n).isNull()), F.lit(False)).alias(f"t{i}")
        for i, n in enumerate(names)
    ]
    row = df.agg(*checks).first() if names else []
    return [n for n, is_text in zip(names, row) if is_text]


def fit_labels(df: DataFrame, columns: str | Sequence[str], max_rows: int | None = None) -> DataFrame:
    """Code table ``(column, label, code)``: codes from 0 in sorted label order per column.

    The labels are written once, because every encoded column joins with them.
    """
    names = as_list(columns)
    pairs = [F.struct(F.lit(n).alias("column"), q(n).cast("string").alias("label")) for n in names]
    labels = df.select(F.inline(F.array(*pairs))).filter(F.col("label").isNotNull()).distinct()
    ranked = positions(labels, ["column"], ["label"], max_rows)
    return freeze(ranked.withColumnRenamed(POS, "code"))


def _codes(encoders: DataFrame, column: str) -> DataFrame:
    table = encoders.filter(F.col("column") == column).select("label", "code")
    return broadcast_if_small(table)


def encode_labels(df: DataFrame, encoders: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Replace labels by their codes; a label that was not fitted is an error."""
    out, names = df, df.columns
    for name in as_list(columns):
        table = _codes(encoders, name).select(
            F.col("label").alias("__label"), F.col("code").alias("__code")
        )
        unseen = F.raise_error(F.concat(F.lit(f"unseen label in {name}: "), q(name).cast("string")))
        out = out.join(table, q(name).cast("string") == F.col("__label"), "left")
        code = F.coalesce("__code", F.when(q(name).isNotNull(), unseen.cast("long")))
        out = out.withColumn(name, code).drop("__label", "__code")
    return out.select(*cols(names))


def decode_labels(df: DataFrame, encoders: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Replace codes by their labels; a code that was not fitted is an error."""
    out, names = df, df.columns
    for name in as_list(columns):
        table = _codes(encoders, name).select(
            F.col("label").alias("__label"), F.col("code").alias("__code")
        )
        unseen = F.raise_error(F.concat(F.lit(f"unknown code in {name}: "), q(name).cast("string")))
        out = out.join(table, q(name).cast("long") == F.col("__code"), "left")
        label = F.coalesce("__label", F.when(q(name).isNotNull(), unseen.cast("string")))
        out = out.withColumn(name, label).drop("__label", "__code")
    return out.select(*cols(names))


def impute_mean(df: DataFrame, columns: str | Sequence[str], marker: str = "?") -> DataFrame:
    """Numbers with the marker, NULL and NaN replaced by the column mean of the other values.

    Any other text that is not a number raises. One aggregate covers all columns, and its
    single row is joined back.
    """
    names = as_list(columns)
    parsed = df.withColumns({n: nan_to_null(strict_double(F.nullif(F.trim(q(n).cast("string")), F.lit(marker)))) for n in names})
    means = parsed.agg(*[F.avg(q(n)).alias(f"__mean{i}") for i, n in enumerate(names)])
    filled = parsed.join(F.broadcast(means)).withColumns(
        {n: F.coalesce(q(n), F.col(f"__mean{i}")) for i, n in enumerate(names)}
    )
    return filled.select(*cols(df.columns))
