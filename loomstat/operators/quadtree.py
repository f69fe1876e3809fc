"""Candidates for the nearest place by descent in a tree of lon/lat cells that are split where places crowd.

Cells are numbered by interleaved coordinate bits and counted in Spark; a cell of more than ``CROWD`` places is split in
sixteen. Every spot starts at the whole globe and moves down a level per round: of its open cells it takes the children,
learns an upper bound of its nearest distance from a place in each, and drops the cells that lie farther away than
that. So a spot meets the few leaves around it, however many places a city elsewhere within reach holds. Cells of a level
are broadcast while few; the spots are dealt once and keep their partitioning through all rounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.geo import EARTH_RADIUS_KM, haversine_km
from loomstat.plans.limits import broadcast_if_small
from loomstat.plans.scratch import freeze

KM_PER_DEGREE = math.pi * EARTH_RADIUS_KM / 180
# places of a cell that is not split
CROWD = 16
# halvings of each axis (cells of half a metre), and those of one level
BITS = 26
STEP = 2
LEVELS = BITS // STEP
# cells of one level that are broadcast; a cell is some hundred bytes
BROADCAST_CELLS = 200_000
# rounding that a bound may be off by
SLACK_KM = 1e-6
# which bits remain while the bits of a number move apart: fixed values of the usual interleaving
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _apart(bits: Column) -> Column:
    for shift, mask in _SPREAD:
        bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask))
    return bits


def _turned(lon: Column) -> Column:
    """Longitude from -180 up to 180."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def cell_number(lon: Column, lat: Column) -> Column:
    """Number of the smallest cell; ``STEP * 2`` bits less is the cell around it."""
    most = F.lit((1 << BITS) - 1).cast("long")
    x = F.least(F.floor((_turned(lon) + 180) / 360 * (1 << BITS)).cast("long"), most)
    y = F.least(F.floor((lat + 90) / 180 * (1 << BITS)).cast("long"), most)
    return _apart(x).bitwiseOR(F.shiftleft(_apart(y), 1))


def _of_level(number: Column, level: Column) -> Column:
    return F.call_function("shiftright", number, ((LEVELS - level) * 2 * STEP).cast("int"))


def with_box_km(df: DataFrame, lon: str, lat: str, name: str) -> DataFrame:
    """Add the least distance from a spot to the box (west, east, south, north), which does not cross the date line; 0 inside.

    The steps are columns, so that each angle is found once per row.
    """
    here = _turned(F.col(lon))
    west, east, south, north = (F.col(c) for c in ("west", "east", "south", "north"))
    outside = F.least(F.pmod(west - here, F.lit(360.0)), F.pmod(here - east, F.lit(360.0)))
    out = df.withColumn("__turn", F.when(here.between(west, east), 0.0).otherwise(outside))
    # distance along the nearer edge falls towards one latitude on its meridian, seen around the poles
    y, x = F.sin(F.radians(lat)), F.cos(F.radians(lat)) * F.cos(F.radians("__turn"))
    out = out.withColumn("__peak", F.when(F.col("__turn") == 0, F.col(lat)).otherwise(F.degrees(F.atan2(y, x))))
    away = [F.abs(F.pmod(at - F.col("__peak") + 180, F.lit(360.0)) - 180) for at in (south, north)]
    at = F.when(F.col("__peak").between(south, north), F.col("__peak")).when(away[0] < away[1], south).otherwise(north)
    out = out.withColumn("__at", at)
    return out.withColumn(name, haversine_km(F.lit(0.0), F.col(lat), F.col("__turn"), F.col("__at"))).drop("__turn", "__peak", "__at")


def cells(places: DataFrame) -> DataFrame:
    """(level, cell, n, leaf, bounds, a place) of all cells of ``places`` (__plon, __plat) whose parent is split."""
    at = F.explode(F.sequence(F.lit(1), F.lit(LEVELS))).alias("level")
    numbered = places.select("__plon", "__plat", cell_number(F.col("__plon"), F.col("__plat")).alias("number"))
    each = numbered.select("__plon", "__plat", "number", at).withColumn("cell", _of_level(F.col("number"), F.col("level")))
    east = _turned(F.col("__plon"))
    counted = freeze(
        each.groupBy("level", "cell").agg(
            F.count(F.lit(1)).alias("n"), F.min(east).alias("west"), F.max(east).alias("east"),
            F.min("__plat").alias("south"), F.max("__plat").alias("north"), F.min(F.struct("__plon", "__plat")).alias("one"),
        )
    )
    split = counted.filter(F.col("n") > CROWD).select((F.col("level") + 1).alias("level"), F.col("cell").alias("parent"))
    below = counted.withColumn("parent", F.shiftright("cell", 2 * STEP))
    top = below.filter("level = 1")
    out = top.unionByName(below.join(split, ["level", "parent"], "left_semi"))
    return out.withColumn("leaf", (F.col("n") <= CROWD) | (F.col("level") == LEVELS))


def candidates(spots: DataFrame, places: DataFrame, max_km: float) -> DataFrame:
    """Pairs of ``spots`` (__lon, __lat) and places that hold, for each spot, the nearest place within ``max_km`` and all that tie with it."""
    tree = freeze(cells(places))
    sizes = {r["level"]: r["count"] for r in tree.groupBy("level").count().collect()}
    none = F.lit(None).cast("long")
    front = spots.select(
        "__lon", "__lat", _of_level(cell_number(F.col("__lon"), F.col("__lat")), F.lit(0)).alias("__open"), F.lit(None).cast("int").alias("__level"), none.alias("__leaf"),
        F.lit(0.0).alias("__near"), F.lit(float(max_km)).alias("__far"),
    )
    spot = Window.partitionBy("__lon", "__lat")
    for level in range(1, max(sizes, default=0) + 1):
        step = tree.filter(F.col("level") == level).select(
            F.col("parent").alias("__parent"), F.col("cell").alias("__cell"), F.col("leaf").alias("__ends"), "west", "east", "south", "north", "one"
        )
        # leaves have no open cell, so they find no children and stay as they are
        joined = front.join(F.broadcast(step) if sizes[level] <= BROADCAST_CELLS else step, F.col("__open") == F.col("__parent"), "left")
        new = F.col("__cell").isNotNull()
        joined = with_box_km(joined, "__lon", "__lat", "__bound")
        met = haversine_km(F.col("__lon"), F.col("__lat"), F.col("one.__plon"), F.col("one.__plat"))
        measured = joined.select(
            "__lon", "__lat", F.when(new & ~F.col("__ends"), F.col("__cell")).alias("__open"),
            F.when(new & F.col("__ends"), level).otherwise(F.col("__level")).alias("__level"),
            F.when(new & F.col("__ends"), F.col("__cell")).otherwise(F.col("__leaf")).alias("__leaf"),
            F.when(new, F.col("__bound")).otherwise(F.col("__near")).alias("__near"),
            F.least("__far", F.min(F.when(new, met)).over(spot)).alias("__far"),
        )
        front = measured.filter(F.col("__near") <= F.col("__far") + SLACK_KM)
    found = tree.filter("leaf").select(F.col("level").alias("__l"), F.col("cell").alias("__c"))
    at = F.explode(F.sequence(F.lit(1), F.lit(max(sizes, default=1)))).alias("__level")
    placed = places.withColumn("__number", cell_number(F.col("__plon"), F.col("__plat"))).select("*", at)
    placed = placed.withColumn("__leaf", _of_level(F.col("__number"), F.col("__level"))).drop("__number")
    few = sum(sizes.values()) <= BROADCAST_CELLS
    held = placed.join(F.broadcast(found) if few else found, (F.col("__level") == F.col("__l")) & (F.col("__leaf") == F.col("__c"))).drop("__l", "__c")
    return front.select("__lon", "__lat", "__level", "__leaf").join(broadcast_if_small(held), ["__level", "__leaf"]).drop("__level", "__leaf")
