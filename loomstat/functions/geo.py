"""Web-mercator projection, distance and lon/lat grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstat.functions.text import _c

# fixed values: radius of the EPSG 3857 sphere, mean earth radius in km
WEB_MERCATOR_RADIUS = 6378137.0
EARTH_RADIUS_KM = 6371.0088


def webm_to_gps(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    """EPSG 3857 metres to (lon, lat) degrees."""
    lon = F.degrees(_c(x) / WEB_MERCATOR_RADIUS)
    lat = F.degrees(2 * F.atan(F.exp(_c(y) / WEB_MERCATOR_RADIUS)) - math.pi / 2)
    return lon, lat


def gps_to_webm(lon: Column | str, lat: Column | str) -> tuple[Column, Column]:
    """(lon, lat) degrees to EPSG 3857 metres; NULL at and beyond the poles."""
    lat = _c(lat)
    inside = F.abs(lat) < 90
    x = WEB_MERCATOR_RADIUS * F.radians(_c(lon))
    y = WEB_MERCATOR_RADIUS * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))
    return F.when(inside, x), F.when(inside, y)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance on the mean sphere."""
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
