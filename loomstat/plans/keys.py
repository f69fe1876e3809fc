"""Small helpers on column lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def as_list(columns: str | Sequence[str] | None) -> list[str]:
    if columns is None:
        return []
    return [columns] if isinstance(columns, str) else list(columns)


def q(name: str) -> Column:
    """Column by its exact name, also when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def cols(names: Sequence[str]) -> list[Column]:
    return [q(n) for n in names]


def keyed(by: Sequence[str]) -> WindowSpec:
    """Window over a key; callers with an empty key pass small tables only."""
    return Window.partitionBy(*(cols(by) or [F.lit(0)]))


def same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Null-safe equality of two lists of key columns."""
    condition = F.lit(True)
    for a, b in zip(left, right, strict=True):
        condition = condition & a.eqNullSafe(b)
    return condition


def attach(df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on same-named keys, nulls included, keeping the columns of ``df`` in place."""
    if not on:
        # without a key the table is one aggregated row
        return df.join(F.broadcast(table))
    renamed = table
    for name in on:
        renamed = renamed.withColumnRenamed(name, f"__r_{name}")
    condition = same([df[f"`{n}`"] for n in on], [renamed[f"`__r_{n}`"] for n in on])
    joined = df.join(renamed, condition, how)
    return joined.drop(*[f"__r_{n}" for n in on])
