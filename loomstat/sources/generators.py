"""Ranges and artificial data, repeatable for any partitioning."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.functions.calendar import micros_to_ntz, ntz_to_micros
from loomstat.functions.hashing import normal, uniform
from loomstat.plans.keys import q
from loomstat.plans.positions import expand


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _between(start: Column, stop: Column, num: Column, i: Column) -> Column:
    """Point i of num equally spaced numbers; the last one is exactly ``stop``."""
    step = (stop - start) / F.greatest(num - 1, F.lit(1))
    return F.when((i == num - 1) & (num > 1), stop).otherwise(start + i * step)


def _between_micros(start: Column, stop: Column, num: Column, i: Column) -> Column:
    """The same in whole microseconds, rounded half up, without losing digits."""
    gaps = F.greatest(num - 1, F.lit(1)).cast("long")
    span = stop - start
    whole, rest = _div(span, gaps), span % gaps
    part = 2 * i * rest + gaps
    return start + i * whole + _div(part - F.pmod(part, 2 * gaps), 2 * gaps)


def linspace_per_key(df: DataFrame, start: str, stop: str, num: str, name: str = "value") -> DataFrame:
    """``num`` equally spaced values from start to stop for every row; adds ``i``.

    Both bounds are numbers or both are times.
    """
    is_time = _time_bounds(df, start, stop)
    rows = expand(df, num, "i")
    n, i = q(num).cast("long"), F.col("i")
    if is_time:
        value = micros_to_ntz(_between_micros(ntz_to_micros(start), ntz_to_micros(stop), n, i))
    else:
        value = _between(q(start).cast("double"), q(stop).cast("double"), n, i)
    return rows.withColumn(name, value)


def grid_per_key(df: DataFrame, start: str, stop: str, step: float | dt.timedelta, name: str = "value") -> DataFrame:
    """Values start, start + step, ... below stop for every row; adds ``i``.

    ``ceil((stop - start) / step)`` values. Times step by a timedelta, exact in microseconds.
    """
    is_time = _time_bounds(df, start, stop)
    if is_time != isinstance(step, dt.timedelta):
        raise TypeError("times need a timedelta step and numbers a number")
    if is_time:
        width = step // dt.timedelta(microseconds=1)
        a, b = ntz_to_micros(start), ntz_to_micros(stop)
        count = _div(b - a + (width - 1 if width > 0 else width + 1), F.lit(width).cast("long"))
    else:
        a, b = q(start).cast("double"), q(stop).cast("double")
        count = F.ceil((b - a) / float(step))
    rows = expand(df.withColumn("__count", count.cast("long")), "__count", "i").drop("__count")
    value = micros_to_ntz(a + F.col("i") * width) if is_time else a + F.col("i") * float(step)
    return rows.withColumn(name, value)


def _time_bounds(df: DataFrame, start: str, stop: str) -> bool:
    kinds = [dict(df.dtypes)[c].startswith(("timestamp", "date")) for c in (start, stop)]
    if kinds[0] != kinds[1]:
        raise TypeError("start and stop must both be times or both be numbers")
    return kinds[0]


def _bounds(spark: SparkSession, start, stop) -> DataFrame:
    def lit(v):
        return F.lit(v).cast("timestamp_ntz") if isinstance(v, dt.datetime) else F.lit(float(v))

    if isinstance(start, dt.datetime) != isinstance(stop, dt.datetime):
        raise TypeError("start and stop must both be times or both be numbers")
    return spark.range(1).select(lit(start).alias("start"), lit(stop).alias("stop"))


def linspace(spark: SparkSession, start, stop, num: int) -> DataFrame:
    """``num`` equally spaced numbers or times with both ends: ``i``, ``value``."""
    one = _bounds(spark, start, stop).withColumn("num", F.lit(num))
    return linspace_per_key(one, "start", "stop", "num").select("i", "value")


def arange(spark: SparkSession, start, stop, step) -> DataFrame:
    """Numbers or times from start by step, stop excluded: ``i``, ``value``."""
    return grid_per_key(_bounds(spark, start, stop), "start", "stop", step).select("i", "value")


def random_sum(
    ids: DataFrame, id_column: str = "id", features: int = 10, low: float = 0.8, high: float = 1.2,
    seed: int = 0, target: str | None = None,
) -> DataFrame:
    """Columns ``f0..`` that sum to ``frac * y`` for every id row.

    ``y`` is uniform on (0, 1), or the given target column; ``frac`` is uniform between low
    and high. Each feature takes a random share of what is left, the last one also takes
    the rest, and the features are shuffled within the row.
    """
    key = [q(id_column)]
    y = q(target).cast("double") if target else uniform(seed, "y", key)
    frac = low + (high - low) * uniform(seed, "frac", key)
    out = ids.withColumn("y", y).withColumn("frac", frac)
    shares = F.array(*[uniform(seed, f"share{i}", key) for i in range(features - 1)]).cast("array<double>")

    def take(state: Column, share: Column) -> Column:
        piece = state["rest"] * share
        return F.struct((state["rest"] - piece).alias("rest"), F.array_append(state["out"], piece).alias("out"))

    begin = F.struct((F.col("frac") * F.col("y")).alias("rest"), F.array().cast("array<double>").alias("out"))
    pieces = F.aggregate(shares, begin, take, lambda s: F.array_append(s["out"], s["rest"]))
    marks = F.array(*[uniform(seed, f"place{i}", key) for i in range(features)])
    mixed = F.array_sort(F.arrays_zip(marks.alias("m"), pieces.alias("p")))
    out = out.withColumn("__f", F.transform(mixed, lambda s: s["p"]))
    return out.withColumns({f"f{i}": F.col("__f")[i] for i in range(features)}).drop("__f")


def blobs(
    ids: DataFrame, id_column: str = "id", features: int = 2, centers: int = 2,
    box: tuple[float, float] = (-10, 10), std: float = 2.0, seed: int = 0,
) -> DataFrame:
    """Gaussian clusters: ``x1..`` around the center of ``label = id mod centers``.

    Consecutive ids give cluster sizes that differ by at most one.
    """
    label = F.pmod(q(id_column), F.lit(centers)).cast("int")
    out = ids.withColumn("label", label)
    points = {}
    for j in range(1, features + 1):
        center = box[0] + (box[1] - box[0]) * uniform(seed, f"center{j}", ["label"])
        points[f"x{j}"] = center + std * normal(seed, f"noise{j}", [q(id_column)])
    return out.withColumns(points)


def tone_mix(
    ids: DataFrame, id_column: str, fs: float, mags: Sequence[float], freqs: Sequence[float],
    noise: float = 1.0, seed: int = 0,
) -> DataFrame:
    """Sum of sine tones at sample number ``id``, plus noise: adds ``time`` and ``y``."""
    time = q(id_column) / F.lit(float(fs))
    y = F.lit(0.0)
    for mag, freq in zip(mags, freqs, strict=True):
        y = y + float(mag) * F.sin(2 * math.pi * float(freq) * F.col("time"))
    if noise:
        y = y + float(noise) * normal(seed, "noise", [q(id_column)])
    return ids.withColumn("time", time).withColumn("y", y)
