"""Random numbers as functions of a row's identity.

A value depends on (seed, stream, id columns) only, so results are the same for
any partitioning and after any retry. ``rand(seed)`` depends on the partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstat.functions.text import _c


def uniform(seed: int, stream: int | str, ids: Sequence[Column | str]) -> Column:
    """Uniform on (0, 1), from 52 hashed bits."""
    bits = F.xxhash64(F.lit(seed), F.lit(str(stream)), *[_c(i) for i in ids])
    return (F.shiftrightunsigned(bits, 12).cast("double") + 0.5) / float(1 << 52)


def normal(seed: int, stream: int | str, ids: Sequence[Column | str]) -> Column:
    """Standard normal by the Box-Muller transform."""
    radius = F.sqrt(-2.0 * F.log(uniform(seed, f"{stream}/r", ids)))
    return radius * F.cos(2.0 * math.pi * uniform(seed, f"{stream}/a", ids))
