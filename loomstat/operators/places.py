"""Nearest place within a distance, through a tree of lon/lat cells or a grid."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions.geo import EARTH_RADIUS_KM, haversine_km
from loomstat.operators.quadtree import candidates
from loomstat.plans.keys import cols, q
from loomstat.plans.limits import broadcast_if_small
from loomstat.plans.scratch import freeze

KM_PER_DEGREE = math.pi * EARTH_RADIUS_KM / 180


def _lat_cell(lat: Column, size: float) -> Column:
    return F.floor((lat + 90) / size).cast("long")


def _lon_cells_of_row(row: Column, size: float) -> Column:
    """Number of equal cells around one latitude row.

    A cell is so wide that two spots within ``size`` degrees of arc, in this row or in the
    rows next to it, are at most one cell apart. Rows near the poles have few, wide cells.
    """
    farthest = F.greatest(F.abs((row - 1) * size - 90), F.abs((row + 2) * size - 90))
    shrink = F.cos(F.radians(F.least(farthest, F.lit(90.0))))
    half = F.least(F.lit(1.0), math.sin(min(math.radians(size) / 2, math.pi / 2)) / shrink)
    return F.greatest(F.lit(1), F.floor(F.lit(180.0) / F.degrees(F.asin(half)))).cast("long")


def _lon_cell(lon: Column, count: Column) -> Column:
    turned = F.pmod(lon + 180, F.lit(360.0))
    return F.least(F.floor(turned / 360 * count).cast("long"), count - 1)


def _with_cell(points: DataFrame, size: float) -> DataFrame:
    row = _lat_cell(F.col("__lat"), size)
    out = points.withColumn("__row", row).withColumn("__n", _lon_cells_of_row(F.col("__row"), size))
    return out.withColumn("__cell", _lon_cell(F.col("__lon"), F.col("__n"))).drop("__n")


def _with_near_cells(places: DataFrame, size: float) -> DataFrame:
    """Each place in its own cell and in every cell that touches it."""
    rows = places.withColumn(
        "__row",
        F.explode(
            F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: _lat_cell(F.col("__plat"), size) + d)
        ),
    ).withColumn("__n", _lon_cells_of_row(F.col("__row"), size))
    near = F.transform(
        F.array(F.lit(-1), F.lit(0), F.lit(1)),
        lambda d: F.pmod(_lon_cell(F.col("__plon"), F.col("__n")) + d, F.col("__n")),
    )
    return rows.withColumn("__cell", F.explode(F.array_distinct(near))).drop("__n")


def _nearest_within(points: DataFrame, places: DataFrame, km: float) -> DataFrame:
    """Add ``__best`` (distance, place id, label), NULL when no place is within ``km``."""
    size = km * 1.0001 / KM_PER_DEGREE
    table = broadcast_if_small(_with_near_cells(places, size))
    return _best(_with_cell(points, size).join(table, ["__row", "__cell"], "left"), km)


def _best(pairs: DataFrame, km: float) -> DataFrame:
    """The nearest place of each spot as ``__best``; ties go to the smaller place id."""
    distance = haversine_km(F.col("__lon"), F.col("__lat"), F.col("__plon"), F.col("__plat"))
    hit = F.struct(distance.alias("d"), F.col("__place").alias("p"), F.col("__label").alias("l"))
    return pairs.groupBy("__lon", "__lat").agg(F.min(F.when(distance <= km, hit)).alias("__best"))


# places that a grid cell of the first round may hold, and the finest grid that is tried for it
CROWD = 64
FINEST_KM = 0.001


def _first_radius(places: DataFrame, max_km: float) -> float:
    """The widest grid in which no cell holds more than ``CROWD`` places, in steps of four.

    All grids are counted in one job; one number for each reaches the driver.
    """
    sizes = [max_km / 16]
    while sizes[-1] / 4 > FINEST_KM:
        sizes.append(sizes[-1] / 4)
    cells = []
    for i, km in enumerate(sizes):
        size = km * 1.0001 / KM_PER_DEGREE
        row = _lat_cell(F.col("__plat"), size)
        cell = _lon_cell(F.col("__plon"), _lon_cells_of_row(row, size))
        cells.append(F.struct(F.lit(i).alias("i"), row.alias("r"), cell.alias("c")))
    counted = places.select(F.inline(F.array(*cells))).groupBy("i", "r", "c").agg(F.count(F.lit(1)).alias("n"))
    most = {r["i"]: r["n"] for r in counted.groupBy("i").agg(F.max("n").alias("n")).collect()}
    return next((km for i, km in enumerate(sizes) if most.get(i, 0) <= CROWD), sizes[-1])


def nearest_place(
    points: DataFrame,
    places: DataFrame,
    max_km: float,
    lon: str = "lon",
    lat: str = "lat",
    place_id: str = "place_id",
    label: Sequence[str] = ("city", "state"),
    place_lon: str = "lon",
    place_lat: str = "lat",
    first_km: float | None = None,
) -> DataFrame:
    """Add ``place`` ('City, ST'), ``place_id`` and ``km`` of the nearest place.

    Points farther than ``max_km`` from every place get NULL; ties go to the smaller place
    id. Equal coordinates are searched once, by descent in a tree of cells that are split where places crowd.

    With ``first_km`` a plain grid is searched instead, which suits places that are spread evenly: from cells of that
    size (0: the widest that hold few places each, at most a sixteenth of ``max_km``), with four times the radius for the
    coordinates that are still open, up to ``max_km``. A hit within the radius of a round is the nearest place
    overall, so no later round can change it.
    """
    spots = points.select(q(lon).cast("double").alias("__lon"), q(lat).cast("double").alias("__lat"))
    spots = spots.filter(F.col("__lon").isNotNull() & F.col("__lat").between(-90, 90)).distinct()
    table = places.select(
        q(place_id).alias("__place"),
        F.concat_ws(", ", *cols(label)).alias("__label"),
        q(place_lon).cast("double").alias("__plon"),
        q(place_lat).cast("double").alias("__plat"),
    ).filter(F.col("__plon").isNotNull() & F.col("__plat").between(-90, 90))
    # of places in one spot only the smallest id can win
    table = table.groupBy("__plon", "__plat").agg(
        F.min("__place").alias("__p"), F.min_by("__label", "__place").alias("__label")
    ).withColumnRenamed("__p", "__place")
    table = freeze(table)
    found = _best(candidates(spots, table, max_km), max_km) if first_km is None else _by_grid(spots, table, max_km, first_km)
    on = (q(lon).cast("double") == F.col("__lon")) & (q(lat).cast("double") == F.col("__lat"))
    return points.join(found, on, "left").select(
        *[points[f"`{c}`"] for c in points.columns],
        F.col("__best.l").alias("place"),
        F.col("__best.p").alias("place_id"),
        F.col("__best.d").alias("km"),
    )


def _by_grid(spots: DataFrame, table: DataFrame, max_km: float, first_km: float) -> DataFrame:
    """The nearest place of each spot in rounds of growing radius."""
    radius = min(first_km or _first_radius(table, max_km), max_km)
    found, todo = None, spots
    while True:
        tried = _nearest_within(todo, table, radius)
        if radius < max_km:
            # read twice: for the hits and for the next round
            tried = freeze(tried)
        done = tried.filter(F.col("__best").isNotNull())
        found = done if found is None else found.unionByName(done)
        if radius >= max_km:
            return found
        todo = tried.filter(F.col("__best").isNull()).select("__lon", "__lat")
        radius = min(4 * radius, max_km)
