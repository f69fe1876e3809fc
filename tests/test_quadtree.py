"""The tree of cells against brute force, and its work where one city holds nearly all places."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.operators import quadtree
from loomstat.operators.places import nearest_place
from tests.conftest import plan_of


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(h, 1)))


def place_frame(spark, places):
    rows = [(i, "C", "S", float(x), float(y)) for i, (x, y) in enumerate(places)]
    return spark.createDataFrame(rows, "place_id long, city string, state string, lon double, lat double")


def test_box_distance_is_the_least(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(300):
        w, e = sorted(rng.uniform(-180, 180, 2))
        s, n = sorted(rng.uniform(-90, 90, 2))
        rows.append(tuple(map(float, (rng.uniform(-180, 180), rng.uniform(-90, 90), w, e, s, n))))
    rows += [(179.0, 10.0, -179.0, -170.0, 0.0, 5.0), (0.0, 90.0, 10.0, 20.0, -5.0, 5.0), (5.0, 5.0, 0.0, 10.0, 0.0, 10.0), (190.0, 0.0, -171.0, -169.0, -1.0, 1.0)]
    frame = spark.createDataFrame(rows, "lon double, lat double, west double, east double, south double, north double")
    for r in quadtree.with_box_km(frame, "lon", "lat", "d").collect():
        grid = [km((r.lon, r.lat), (x, y)) for x in np.linspace(r.west, r.east, 25) for y in np.linspace(r.south, r.north, 25)]
        step = max((r.east - r.west), (r.north - r.south)) / 24 * 111.2
        assert min(grid) - step <= r.d <= min(grid) + 1e-6


def test_cells_are_split_until_few_are_left(spark):
    rng = np.random.default_rng(2)
    spots = np.concatenate([rng.uniform((-180, -90), (180, 90), (200, 2)), (7, 50) + rng.normal(size=(2000, 2)) * 0.01])
    places = place_frame(spark, spots).select(F.col("lon").alias("__plon"), F.col("lat").alias("__plat"))
    tree = quadtree.cells(places).collect()
    assert sum(r["n"] for r in tree if r["leaf"]) == len(spots)
    assert max(r["n"] for r in tree if r["leaf"]) <= quadtree.CROWD
    parents = {(r["level"], r["cell"]) for r in tree if not r["leaf"]}
    assert all(r["level"] == 1 or (r["level"] - 1, r["parent"]) in parents for r in tree)


@pytest.mark.parametrize("crowd, few", [(16, 200_000), (2, 0)])
def test_tree_equals_brute_force(spark, monkeypatch, crowd, few):
    """Poles, the date line, ties, a dense town, spots far from everything; cells broadcast or joined."""
    monkeypatch.setattr(quadtree, "CROWD", crowd)
    monkeypatch.setattr(quadtree, "BROADCAST_CELLS", few)
    rng = np.random.default_rng(3)
    places = [*rng.uniform((-180, -90), (180, 90), (60, 2)), *((30, 60) + rng.normal(size=(150, 2)) * 0.02)]
    places += [(-179.9, 10.0), (170.0, 89.5), (-100.0, -89.8), (181.0, 12.0), (0.0, 1.0), (0.0, -1.0), (180.0, 0.0), (-180.0, 0.5)]
    points = [*rng.uniform((-180, -90), (180, 90), (80, 2)), *((30, 60) + rng.normal(size=(40, 2)))]
    points += [(179.99, 10.0), (-180.0, 10.0), (0.0, 90.0), (12.0, -89.9), (0.0, 0.0), (540.0, 0.2), tuple(places[70])]
    frame = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)] + [(-1, None, 0.0), (-2, 0.0, 91.0)], "id long, lon double, lat double")
    for max_km in (700, 30_000):
        out = nearest_place(frame, place_frame(spark, places), max_km)
        assert "NestedLoop" not in plan_of(out) and "Cartesian" not in plan_of(out)
        rows = {r["id"]: r for r in out.collect()}
        assert len(rows) == len(points) + 2 and rows[-1]["place_id"] is None is rows[-2]["place_id"]
        for i, point in enumerate(points):
            distances = [(km(point, p), k) for k, p in enumerate(places)]
            best = min(distances)[0]
            tied = [k for d, k in distances if d <= best + 1e-9]
            if best <= max_km:
                assert rows[i]["km"] == pytest.approx(best, abs=1e-6) and rows[i]["place_id"] in tied
            else:
                assert rows[i]["place_id"] is None
    assert nearest_place(frame, place_frame(spark, []), 100).filter("place_id IS NOT NULL").count() == 0
    assert nearest_place(frame.limit(0), place_frame(spark, places), 100).count() == 0


@pytest.mark.parametrize("factor", [1, 4])
def test_candidates_of_a_crowded_city_grow_linearly(spark, factor):
    """A city with 100,000 places within reach of all points, most of which lie outside."""
    n = 25_000 * factor
    city = spark.range(n).select(
        (2 + F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1e7).alias("__plon"), (48 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_003)) / 1e7).alias("__plat")
    )
    around = spark.range(500 * factor).select(
        (-8 + F.pmod(F.xxhash64("id", F.lit(2)), F.lit(20_000)) / 1000).alias("__lon"), (40 + F.pmod(F.xxhash64("id", F.lit(3)), F.lit(15_000)) / 1000).alias("__lat")
    )
    pairs = quadtree.candidates(around.distinct(), city.distinct(), 1500)
    assert pairs.count() <= 500 * factor * 4 * quadtree.CROWD
