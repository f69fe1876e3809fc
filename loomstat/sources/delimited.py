"""Delimited and whitespace-separated text, read as strings with a strict field count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.plans.keys import q


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str],
    sep: str = ",",
    header: bool = False,
    select: Sequence[str] | None = None,
    encoding: str = "UTF-8",
) -> DataFrame:
    """Text columns, blanks stripped; a row with another field count is an error.

    Column pruning in the parser is off, since a pruned parser does not see short rows.
    ``select`` picks columns after the check.
    """
    reader = spark.read.schema(text_schema(columns)).options(
        sep=sep,
        header=header,
        encoding=encoding,
        mode="FAILFAST",
        columnPruning="false",
        enforceSchema=not header,
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
    )
    df = reader.csv(path)
    return df.select(*[q(c) for c in select]) if select else df


def fields_to_columns(lines: DataFrame, fields: Column, columns: Sequence[str]) -> DataFrame:
    """Columns from an array of fields; another field count raises when the row is read."""
    parts = lines.select(fields.alias("__f"))
    wrong = F.raise_error(
        F.concat(F.lit(f"expected {len(columns)} fields: "), F.concat_ws("|", "__f"))
    ).cast("array<string>")
    parts = parts.select(F.when(F.size("__f") == len(columns), F.col("__f")).otherwise(wrong).alias("__f"))
    return parts.select(*[F.trim(F.col("__f")[i]).alias(c) for i, c in enumerate(columns)])


def split_whitespace(lines: DataFrame, column: str, columns: Sequence[str]) -> DataFrame:
    """Columns from lines whose fields are separated by runs of blanks."""
    text = F.trim(F.regexp_replace(q(column), r"\s+", " "))
    rows = lines.select(text.alias("__line")).filter(F.col("__line") != "")
    return fields_to_columns(rows, F.split("__line", " "), columns)


def read_whitespace(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Text columns separated by runs of blanks; empty lines are skipped."""
    return split_whitespace(spark.read.text(path), "value", columns)
