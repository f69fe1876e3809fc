import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.functions.zones import DEFAULT_ZONES, resolve_zone
from loomstat.operators import joins, ordering, quality
from loomstat.operators.places import nearest_place
from tests.conftest import plan_of


def test_check_report(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0, ["x", "y"]), (2, "a", float("nan"), ["x"]), (3, None, 2.0, ["x", "y"])],
        "i int, t string, v double, f array<string>",
    )
    out = quality.check(
        df, rows=4, no_nulls=["t", "v"], unique=["i", "t"], columns=["i", "zz"], width=("f", 2)
    ).collect()
    got = {(r["check"], r["column"]): r["failures"] for r in out}
    assert got == {
        ("column", "i"): 0,
        ("column", "zz"): 1,
        ("rows", ""): 1,
        ("no_nulls", "t"): 1,
        ("no_nulls", "v"): 1,
        ("unique", "i"): 0,
        ("unique", "t"): 1,
        ("width", "f"): 1,
    }
    with pytest.raises(Exception, match="check failed: rows"):
        quality.check(df, rows=4, fail=True).collect()


def test_numbers(spark):
    df = spark.createDataFrame([("1.5", "4,1"), (" 2 ", "5")], "a string, b string")
    assert [r.a for r in quality.to_numeric(df, "a").collect()] == [1.5, 2.0]
    bad = df.union(spark.createDataFrame([("x", "1")], df.schema))
    assert quality.bad_rows(bad, "a").count() == 1
    with pytest.raises(Exception, match="not a number"):
        quality.to_numeric(bad, "a").collect()
    nan = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "v double")
    assert quality.drop_missing(nan, "v").count() == 1


@pytest.mark.parametrize("broadcast_rows", ["0", "1000"])
def test_validate_entries(spark, broadcast_rows):
    spark.conf.set("spark.loomstat.broadcastRows", broadcast_rows)
    words = ["a", "", "A", "enter", "toolong", "bb", "a", "old", "bb", None]
    df = spark.createDataFrame(list(enumerate(words)), "i int, t string")
    old = spark.createDataFrame([("OLD",)], "t string")
    out = quality.validate_entries(df, "t", "i", upper=True, max_len=5, placeholder="ENTER", existing=old)
    spark.conf.unset("spark.loomstat.broadcastRows")
    got = [r.reason for r in out.orderBy("i").collect()]
    assert got == [None, "empty", "present", "placeholder", "too_long", None, "present", "present", "present", "empty"]
    free = quality.validate_entries(df, "t", "i", unique=False, exact_len=1).orderBy("i").collect()
    assert [r.reason for r in free][:3] == [None, "empty", None] and free[5].reason == "wrong_length"


def test_normalize_dates(spark):
    df = spark.createDataFrame(
        [(0, "2020-02-03"), (1, "03/02/2020"), (2, "nope"), (3, "2020-02-04")], "i int, d string"
    )
    out = quality.normalize_dates(df, "d", "i", ["yyyy-MM-dd", "dd/MM/yyyy"]).orderBy("i").collect()
    assert [r.d for r in out] == ["03 February 2020", "03 February 2020", None, "04 February 2020"]
    assert [r.reason for r in out] == [None, "present", "unparseable", None]


def test_repeats_are_looked_up_without_moving_the_table(spark):
    df = spark.range(2000).select("id", F.concat(F.lit("2020-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")).alias("d"))
    out = quality.normalize_dates(df, "d", "id", ["yyyy-MM-dd"])
    text = plan_of(out)
    assert "hashpartitioning" not in text and "rangepartitioning" not in text
    assert out.filter("reason is null").agg(F.max("id"), F.count("*")).first()[:] == (27, 28)


def test_sample_of_repeated_keys(spark):
    one = spark.range(0, 50_000, 1, 8).select((F.col("id") % 2).alias("k"), F.lit("x").alias("v"))
    for n in (1, 20_000, 30_001, 50_000):
        assert quality.sample_exact(one, n, 3, "k").count() == n
    assert quality.sample_exact(one, 0, 3, "k").count() == 0


def test_sample_exact(spark):
    df = spark.range(300_000)
    small = quality.sample_exact(df, 50, 7, "id")
    assert "TakeOrdered" in plan_of(small)
    ids = {r.id for r in small.collect()}
    assert len(ids) == 50
    assert ids == {r.id for r in quality.sample_exact(df.repartition(13), 50, 7, "id").collect()}
    assert ids != {r.id for r in quality.sample_exact(df, 50, 8, "id").collect()}
    big = quality.sample_exact(df, 120_000, 7, "id")
    assert big.count() == 120_000 and big.distinct().count() == 120_000
    want = df.withColumn("h", F.xxhash64(F.lit(7), "id")).orderBy("h", "id").limit(120_000)
    assert big.join(want, "id", "left_anti").count() == 0
    with pytest.raises(ValueError):
        quality.sample_exact(df, 300_001, 7, "id")


def test_views_and_shapes(spark):
    df = spark.createDataFrame([(1, None, 2)], "a int, t string, b int")
    assert quality.table_view(df, ["a"]).columns == ["a"]
    assert quality.table_view(df, ["a"], others=True).columns == ["a", "t", "b"]
    with pytest.raises(ValueError):
        quality.table_view(df, ["zz"])
    with pytest.raises(Exception, match="NULL in required"):
        quality.table_view(df, ["t"], required=["t"]).collect()
    nested = spark.range(1).select(F.struct(F.lit(1).alias("x"), F.struct(F.lit(2).alias("z")).alias("y")).alias("s"), "id")
    assert quality.flatten_nested(nested).columns == ["s.x", "s.y.z", "id"]
    rows = quality.series_to_rows(df.select("a", "b"), "a", ["b"]).collect()
    assert [tuple(r) for r in rows] == [(1, "b", 2)]
    x, y = quality.split_xy(df, ["a"], "b")
    assert (x.columns, y.columns) == (["a"], ["b"])
    assert quality.rename_columns(df, {"a": "q", "nope": "r"}).columns == ["q", "t", "b"]
    assert quality.contains_ci(spark.createDataFrame([("Abc",), ("x",)], "t string"), "t", "BC").count() == 1


def test_ordering(spark):
    df = spark.createDataFrame([(0, 2.0), (1, None), (2, float("nan")), (3, 1.0)], "i long, v double")
    assert [r.i for r in ordering.sort_by(df, "v").collect()] == [3, 0, 2, 1]
    assert [r.i for r in ordering.order_by_list(df, "i", [2, 0, 3, 1]).collect()] == [2, 0, 3, 1]
    with pytest.raises(ValueError):
        ordering.order_by_list(df, "i", [0, 1, 2])
    keyed = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, t string")
    assert {(r.k, r.t) for r in ordering.first_per_group(keyed, "k", "o").collect()} == {("a", "y"), ("b", "z")}
    both = ordering.stack_samples({"x": df, "y": df})
    assert both.groupBy("sample").count().count() == 2


def test_align(spark):
    a = spark.createDataFrame([("p", 1, 0), ("q", 2, 1)], "l string, v int, o int")
    b = spark.createDataFrame([("q", 5, 0), ("z", 6, 1), ("y", 7, 2)], "l string, v int, o int")
    out = joins.align_series(a, b, "l", "v", "o").orderBy("is_existing", "position").collect()
    assert [(r.l, r.value_a, r.value_b) for r in out] == [("z", 0, 6), ("y", 0, 7), ("p", 1, 0), ("q", 2, 5)]
    with pytest.raises(Exception, match="label occurs twice"):
        joins.align_series(a.union(a), b, "l", "v", "o").collect()
    assert joins.labels_not_in(a, b, "l").count() == 1 and joins.labels_in(a, b, "l").count() == 1
    many = joins.align_many(ordering.stack_samples({"a": a, "b": b}), "l", "sample", "v", ["a", "b"])
    assert {tuple(r) for r in many.collect()} == {("p", 1, 0), ("q", 2, 5), ("z", 0, 6), ("y", 0, 7)}
    named = ordering.stack_samples({"a": a, "b": b})
    placed = joins.align_many(named, "l", "sample", "v", ["a", "b"], order="o").orderBy("is_existing", "position")
    assert [r.l for r in placed.collect()] == ["z", "y", "p", "q"]
    for name in ("a", "b", "position", "is_existing"):
        with pytest.raises(Exception, match="label occurs twice"):
            joins.align_many(named.union(named), "l", "sample", "v", ["a", "b"], order="o").select(name).collect()


def test_time_zones(spark):
    times = ["2023-11-05 01:30:00", "2023-11-05 02:30:00", "2023-03-12 02:30:00"]
    df = spark.createDataFrame([(t, "US/Pacific") for t in times], "t string, z string")
    df = df.withColumn("t", F.col("t").cast("timestamp_ntz"))
    out = joins.utc_candidates(df, "t", "z").orderBy("t").collect()
    assert [str(r.datetime_utc) for r in out] == ["2023-03-12 10:30:00", "2023-11-05 09:30:00", "2023-11-05 10:30:00"]
    assert [r.hrs_wrt_utc for r in out] == [-8, -8, -8]
    pst = joins.utc_candidates(df.withColumn("z", F.lit("PST")).limit(1), "t", "z")
    assert pst.count() == 20
    one = joins.filter_expected_zone(pst, "t", "LOS_A").collect()
    assert [r.equivalent_zone for r in one] == ["America/Los_Angeles"]
    assert joins.utc_candidates(df.withColumn("z", F.lit("JST")).limit(1), "t", "z").count() == 10
    names = ["Asia/Tokyo", "XX", *DEFAULT_ZONES]
    got = spark.createDataFrame([(n,) for n in names], "z string").select(resolve_zone("z").alias("r")).collect()
    assert [r.r for r in got] == ["Asia/Tokyo", None, *DEFAULT_ZONES.values()]


def test_utc_equals_pytz(spark):
    import datetime as dt

    import pytz

    rng = np.random.default_rng(0)
    zones = ["America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "Asia/Kolkata", "America/Sao_Paulo", "Antarctica/Troll"]
    rows = []
    for zone in zones:
        changes = [c for c in pytz.timezone(zone)._utc_transition_times if dt.datetime(1990, 1, 1) < c < dt.datetime(2024, 1, 1)]
        for c in changes:
            for h in rng.uniform(-14, 14, 4):
                rows.append(((c + dt.timedelta(hours=float(h))).replace(microsecond=0), zone))
    df = spark.createDataFrame([(str(t), z) for t, z in rows], "t string, z string")
    out = joins.utc_candidates(df.withColumn("t", F.col("t").cast("timestamp_ntz")), "t", "z").collect()
    for r in out:
        want = pytz.timezone(r.z).localize(r.t).astimezone(pytz.utc).replace(tzinfo=None)
        assert r.datetime_utc == want, (r.t, r.z)


def test_crowded_places_start_on_a_fine_grid(spark):
    from loomstat.operators import places as module

    crowd = spark.range(10_000).select(
        F.col("id").alias("place_id"), F.lit("C").alias("city"), F.lit("S").alias("state"),
        (7 + F.pmod(F.xxhash64("id"), F.lit(10_000)) / 1e6).alias("lon"), (50 + F.pmod(F.hash("id"), F.lit(10_000)) / 1e6).alias("lat"),
    )
    table = crowd.select(F.col("lon").alias("__plon"), F.col("lat").alias("__plat"))
    radius = module._first_radius(table, 1500)
    size = radius * 1.0001 / module.KM_PER_DEGREE
    spots = table.select(F.col("__plon").alias("__lon"), F.col("__plat").alias("__lat"))
    near = module._with_near_cells(table, size)
    # at most nine cells of CROWD places for each point, instead of all 10,000
    assert module._with_cell(spots, size).join(near, ["__row", "__cell"]).count() <= 10_000 * 9 * module.CROWD
    out = nearest_place(crowd.select("place_id", "lon", "lat").withColumnRenamed("place_id", "id"), crowd, 1500)
    assert out.filter("km < 1e-9").count() == 10_000


def haversine(a, b):
    p, q = map(math.radians, (a[1], b[1]))
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(h, 1)))


@pytest.mark.parametrize("max_km, first_km", [(300, None), (300, 20), (4000, 500)])
def test_nearest_place_equals_brute_force(spark, max_km, first_km):
    rng = np.random.default_rng(9)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 250), rng.uniform(-90, 90, 250)))]
    points += [(900, 179.99, 10.0), (901, -180.0, 10.0), (902, 0.0, 90.0), (903, 12.0, -89.9), (904, 179.99, 10.0)]
    places = [(i, f"C{i}", "ST", float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 300), rng.uniform(-90, 90, 300)))]
    places += [(950, "W", "ST", -179.9, 10.0), (951, "N", "ST", 170.0, 89.5), (952, "S", "ST", -100.0, -89.8)]
    p = spark.createDataFrame(points, "id int, lon double, lat double")
    g = spark.createDataFrame(places, "place_id int, city string, state string, lon double, lat double")
    out = nearest_place(p, g, max_km, first_km=first_km)
    text = plan_of(out)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    rows = out.collect()
    assert len(rows) == len(points)
    for r in rows:
        best = min((haversine((r.lon, r.lat), (x, y)), i) for i, _, _, x, y in places)
        if best[0] <= max_km:
            assert r.place_id == best[1] and r.km == pytest.approx(best[0], abs=1e-6)
        else:
            assert r.place_id is None
