"""Hash aggregates; Spark combines all of them map-side, so heavy keys are fine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions.geo import gps_to_webm
from loomstat.functions.signal import bin_center, padded
from loomstat.functions.text import _c, nan_to_null, valid
from loomstat.plans.keys import as_list, cols, q


def total_range(df: DataFrame, by: str | Sequence[str] | None, column: str) -> DataFrame:
    """Largest minus smallest value, as ``total_range``."""
    c = nan_to_null(q(column).cast("double"))
    return df.groupBy(*cols(as_list(by))).agg((F.max(c) - F.min(c)).alias("total_range"))


def distinct_values(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    return df.select(*cols(as_list(columns))).distinct()


def axis_range(df: DataFrame, by: str | Sequence[str] | None, column: str) -> DataFrame:
    """Axis limits ``low``, ``high``; a single value is widened to zero, zero to (-1, 1).

    A key without any valid value is an error.
    """
    c = nan_to_null(q(column).cast("double"))
    bounds = df.groupBy(*cols(as_list(by))).agg(F.min(c).alias("__a"), F.max(c).alias("__b"))
    a = F.coalesce(F.col("__a"), F.raise_error(F.lit("axis_range: no valid value")).cast("double"))
    b, single = F.col("__b"), F.col("__a") == F.col("__b")
    return bounds.select(
        *cols(as_list(by)),
        F.when(single & (a == 0), -1.0).when(single & (a > 0), 0.0).otherwise(a).alias("low"),
        F.when(single & (a == 0), 1.0).when(single & (a < 0), 0.0).otherwise(b).alias("high"),
    )


def view_ranges(
    lon0: Column | str,
    lon1: Column | str,
    lat0: Column | str,
    lat1: Column | str,
    aspect: float,
    border: float = 0.05,
) -> tuple[Column, Column, Column, Column]:
    """Padded ranges (x0, x1, y0, y1) that keep width / height at ``aspect``.

    The limiting side gets a border on both ends; the other side is widened to match.
    """
    lon0, lon1, lat0, lat1 = _c(lon0), _c(lon1), _c(lat0), _c(lat1)
    dlon, dlat = lon1 - lon0, lat1 - lat0
    by_lon = dlon > aspect * dlat
    grow = 1 + 2 * border
    x_margin = F.when(by_lon, border * dlon).otherwise((grow * dlat * aspect - dlon) / 2)
    y_margin = F.when(by_lon, (grow * dlon / aspect - dlat) / 2).otherwise(border * dlat)
    return lon0 - x_margin, lon1 + x_margin, lat0 - y_margin, lat1 + y_margin


def map_viewport(
    df: DataFrame,
    by: str | Sequence[str] | None,
    lon: str,
    lat: str,
    aspect: float,
    border: float = 0.05,
) -> DataFrame:
    """Web-mercator map view ``x0, x1, y0, y1`` that shows all points of a key."""
    by = as_list(by)
    x, y = (nan_to_null(q(c).cast("double")) for c in (lon, lat))
    box = df.groupBy(*cols(by)).agg(
        F.min(x).alias("__lon0"), F.max(x).alias("__lon1"), F.min(y).alias("__lat0"), F.max(y).alias("__lat1")
    )
    wx0, wy0 = gps_to_webm("__lon0", "__lat0")
    wx1, wy1 = gps_to_webm("__lon1", "__lat1")
    corners = box.select(
        *cols(by), wx0.alias("__x0"), wx1.alias("__x1"), wy0.alias("__y0"), wy1.alias("__y1")
    )
    x0, x1, y0, y1 = view_ranges("__x0", "__x1", "__y0", "__y1", aspect, border)
    return corners.select(*cols(by), x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))


def curve_band(df: DataFrame, by: str | Sequence[str] | None, x: str, y: str) -> DataFrame:
    """Mean, minimum and maximum of repeated scores per key and ``x``."""
    c = nan_to_null(q(y).cast("double"))
    return df.groupBy(*cols([*as_list(by), x])).agg(
        F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max")
    )


def interval_extent(
    df: DataFrame,
    by: str | Sequence[str] | None,
    start: str = "start",
    end: str = "end",
    order: str | Sequence[str] | None = None,
) -> DataFrame:
    """Axis extent ``low``, ``high`` of interval rows.

    Times: one hour before the first row's start to one hour after the last row's end,
    first and last by ``order``. Numbers: 1 % of the span beyond both ends. Both columns
    must be of one kind, and an interval that ends before it starts is an error.
    """
    by = as_list(by)
    kinds = dict(df.dtypes)
    times = [kinds[c].startswith(("timestamp", "date")) for c in (start, end)]
    if times[0] != times[1]:
        raise TypeError("start and end must both be times or both be numbers")
    s, e = q(start), q(end)
    bad = F.raise_error(F.lit("interval_extent: end before start"))
    if not times[0]:
        s, e = nan_to_null(s.cast("double")), nan_to_null(e.cast("double"))
    wrong = e < s
    # in both bounds, so that selecting one of them does not skip the check
    s, e = (F.when(wrong, bad.cast(kinds[c] if times[0] else "double")).otherwise(x) for c, x in ((start, s), (end, e)))
    if times[0]:
        if not order:
            raise ValueError("time intervals need an order")
        key = F.struct(*cols(as_list(order)))
        hour = F.expr("interval 1 hour")
        return df.groupBy(*cols(by)).agg(
            (F.min_by(s, key) - hour).alias("low"), (F.max_by(e, key) + hour).alias("high")
        )
    ends = df.groupBy(*cols(by)).agg(F.min(s).alias("__low"), F.max(e).alias("__high"))
    low, high = padded("__low", "__high")
    return ends.select(*cols(by), low.alias("low"), high.alias("high"))


def histogram(
    df: DataFrame,
    by: str | Sequence[str] | None,
    column: str,
    edges: Sequence[float],
    pdf: bool = False,
) -> DataFrame:
    """Counts in equally wide half-open bins ``[edge, next edge)``.

    Values beyond the edges go to one more bin of the same width on either side, which is
    listed only when it is not empty. Empty bins inside are listed with 0. ``pdf`` gives
    each bin's share of the key's rows. Output: ``left, width, height, center``.
    """
    edges = [float(e) for e in edges]
    steps = [b - a for a, b in zip(edges, edges[1:])]
    if not steps or min(steps) <= 0 or any(abs(s - steps[0]) > 1e-8 + 1e-5 * abs(s) for s in steps):
        raise ValueError("edges must ascend in equal steps")
    by, width, bins = as_list(by), steps[0], len(edges) + 1
    values = df.filter(valid(column)).select(*cols(by), q(column).cast("double").alias("__v"))
    inf = float("inf")
    cutter = Bucketizer(splits=[-inf, *edges, inf], inputCol="__v", outputCol="__bin")
    counts = (
        cutter.transform(values)
        .groupBy(*cols(by), F.col("__bin").cast("int").alias("__bin"))
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    # at most one entry per bin and key, so the map is as small as the edge list
    per_key = counts.groupBy(*cols(by)).agg(
        F.map_from_entries(F.collect_list(F.struct("__bin", "__c"))).alias("__counts"),
        F.coalesce(F.sum("__c"), F.lit(0)).alias("__total"),
    )
    lefts = F.array(*[F.lit(e) for e in [edges[0] - width, *edges]])
    rights = F.array(*[F.lit(e) for e in [*edges, edges[-1] + width]])
    rows = per_key.select(
        *cols(by), "__counts", "__total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("__i")
    )
    left, right = F.element_at(lefts, F.col("__i") + 1), F.element_at(rights, F.col("__i") + 1)
    found = F.coalesce(F.try_element_at("__counts", F.col("__i")), F.lit(0))
    outer = F.col("__i").isin(0, bins - 1)
    shown = rows.withColumn("__c", found).filter((F.col("__c") > 0) | ~outer)
    height = F.col("__c") / F.col("__total") if pdf else F.col("__c")
    return shown.select(
        *cols(by),
        left.alias("left"),
        F.lit(width).alias("width"),
        height.alias("height"),
        bin_center(left, right).alias("center"),
    )
