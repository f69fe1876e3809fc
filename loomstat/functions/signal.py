"""Scalar functions on frequencies and bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstat.functions.text import _c


def aliased_freq(f: Column | str, fs: Column | float) -> Column:
    """Frequency at which ``f`` appears when sampled at ``fs`` (``f >= 0``)."""
    f = _c(f)
    nyquist = (F.lit(float(fs)) if isinstance(fs, (int, float)) else fs) / 2
    rest = f % nyquist
    return F.when(F.floor(f / nyquist) % 2 == 0, rest).otherwise(nyquist - rest)


def bin_center(left: Column | str, right: Column | str) -> Column:
    """Midpoint of two edges."""
    return (_c(left) + _c(right)) / 2


def padded(low: Column | str, high: Column | str, share: float = 0.01) -> tuple[Column, Column]:
    """Both ends moved outward by a share of the span."""
    low, high = _c(low), _c(high)
    margin = share * (high - low)
    return low - margin, high + margin
