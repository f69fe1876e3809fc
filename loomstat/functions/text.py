"""Text and number formatting functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstat.plans.keys import q


def _c(column: Column | str) -> Column:
    return q(column) if isinstance(column, str) else column


def ordinal(n: Column | str) -> Column:
    """1 to '1st', 12 to '12th', 21 to '21st'; negative numbers give NULL."""
    n = _c(n)
    unit = F.pmod(n, F.lit(10))
    teen = F.pmod(n, F.lit(100)).between(10, 19)
    suffix = (
        F.when(teen, "th").when(unit == 1, "st").when(unit == 2, "nd").when(unit == 3, "rd").otherwise("th")
    )
    return F.when(n >= 0, F.concat(n.cast("string"), suffix))


def safe_filename(text: Column | str) -> Column:
    """Keep letters, digits, blank, dot and underscore, then trim on the right."""
    return F.rtrim(F.regexp_replace(_c(text), r"[^\p{L}\p{N} ._]", ""))


def decimal_comma(text: Column | str) -> Column:
    """'4,1' to 4.1; text that is not a number then raises."""
    return strict_double(F.replace(_c(text), F.lit(","), F.lit(".")))


def try_double(text: Column | str) -> Column:
    """Number, or NULL when the text is not one ('1d' and '1f' are not)."""
    text = F.trim(_c(text).cast("string"))
    return F.when(~text.rlike(r"[0-9.][dDfF]$"), text.try_cast("double"))


def strict_double(text: Column | str) -> Column:
    """Number; a text that is not one raises, whatever the session's ANSI setting."""
    text = _c(text)
    bad = F.raise_error(F.concat(F.lit("not a number: "), text.cast("string"))).cast("double")
    return F.coalesce(try_double(text), F.when(text.isNotNull(), bad))


def folder_label(path: Column | str) -> Column:
    """Name of the folder that holds the last path element; NULL without one."""
    return F.try_element_at(F.split(_c(path), "/"), F.lit(-2))


def block_label(columns: Sequence[Column | str]) -> Column:
    """Values of a row's label columns joined by ', '."""
    return F.concat_ws(", ", *[_c(c) for c in columns])


def contains_ci_expr(text: Column | str, term: str) -> Column:
    """Case-insensitive substring test; the empty term is in every text."""
    return F.lower(_c(text)).contains(F.lower(F.lit(term)))


def valid(column: Column | str) -> Column:
    """True when a number is neither NULL nor NaN."""
    column = _c(column)
    return column.isNotNull() & ~F.isnan(column)


def nan_to_null(column: Column | str) -> Column:
    column = _c(column)
    return F.when(~F.isnan(column), column)
