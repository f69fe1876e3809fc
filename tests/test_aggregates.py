import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.operators import aggregates as agg
from loomstat.operators.encode import decode_labels, encode_labels, fit_labels, impute_mean, text_columns
from loomstat.operators.ranks import central_interval, percentiles
from loomstat.operators.substring import common_substring


def one(spark, values, kind="double"):
    values = [None if v is None else float(v) for v in values]
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


@pytest.mark.parametrize("max_rows", [3, 1000])
@pytest.mark.parametrize(
    "values, x, want",
    [
        (range(1, 11), 0.5, (3, 7)),
        ([1, 2, 3, 4, 5, 6, 7, 800, 900, 1000], 0.5, (4, 800)),
        ([-1, -2, -3, 4, 5, 6, 7, 8, 9, 10], 0.5, (-1, 7)),
        ([1, 2], 0.5, (1, 1)),
        ([1, 5, 6, 7, 8, 9, 10, 11, 12, 13], 0.9, (1, 12)),
        ([1, 2, 6, 7, 8, 9, 10, 11, 12, 14], 0.9, (2, 14)),
        ([4], 1.0, (4, 4)),
    ],
)
def test_central_interval(spark, max_rows, values, x, want):
    row = central_interval(one(spark, [float(v) for v in values]), None, "v", x, max_rows).first()
    assert (row.lower, row.upper) == want


def brute_interval(values, x):
    """Widest interval after dropping as many values as the share allows, as evenly as can be."""
    v = sorted(values)
    n = len(v)
    drops = [(low, high) for low in range(n) for high in range(n - low) if abs(low - high) <= 1 and (n - low - high) / n >= x]
    most = max(map(sum, drops))
    kept = [(v[low], v[n - 1 - high]) for low, high in drops if low + high == most]
    return max(kept, key=lambda k: k[1] - k[0])


@pytest.mark.parametrize("max_rows", [5, 1000])
def test_central_interval_keyed_with_ties(spark, max_rows):
    rng = np.random.default_rng(1)
    rows = [("a", float(v)) for v in rng.integers(0, 30, 300)] + [("b", float(v)) for v in rng.normal(size=9)]
    rows += [("c", float("nan")), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r.k: (r.lower, r.upper) for r in central_interval(df, "k", "v", 0.83, max_rows).collect()}
    assert got == {k: brute_interval([v for kk, v in rows if kk == k], 0.83) for k in "ab"}


@pytest.mark.parametrize("max_rows", [4, 1000])
def test_percentiles(spark, max_rows):
    rng = np.random.default_rng(2)
    values = [float(v) for v in np.round(rng.normal(size=101), 1)]
    df = one(spark, [*values, None, float("nan")]).repartition(4)
    ps = [0, 0.025, 0.5, 0.975, 1]
    got = {r.p: r.value for r in percentiles(df, None, "v", ps, max_rows).collect()}
    for p in ps:
        assert got[p] == pytest.approx(np.percentile(values, 100 * p), abs=1e-12)
    assert percentiles(df.filter("false"), None, "v", ps).count() == 0


def test_histogram(spark):
    df = one(spark, [0.0, 1, 1.5, 3, 3.1, -1, float("nan"), None])
    rows = agg.histogram(df, None, "v", [0, 1, 2, 3]).orderBy("left").collect()
    assert [(r.left, r.height) for r in rows] == [(-1, 1), (0, 1), (1, 2), (2, 0), (3, 2)]
    assert [r.center for r in rows] == [-0.5, 0.5, 1.5, 2.5, 3.5]
    inside = agg.histogram(one(spark, [0.5, 2.5]), None, "v", [0, 1, 2, 3], pdf=True).orderBy("left").collect()
    assert [(r.left, r.height) for r in inside] == [(0, 0.5), (1, 0), (2, 0.5)]
    with pytest.raises(ValueError):
        agg.histogram(df, None, "v", [0, 1, 3])


def test_simple_ranges(spark):
    assert agg.total_range(one(spark, [3.0, -1.0, None]), None, "v").first().total_range == 4
    df = spark.createDataFrame(
        [("z", 0.0), ("p", 2.0), ("p", 2.0), ("n", -3.0), ("m", 1.0), ("m", 4.0)], "k string, v double"
    )
    got = {r.k: (r.low, r.high) for r in agg.axis_range(df, "k", "v").collect()}
    assert got == {"z": (-1, 1), "p": (0, 2), "n": (-3, 0), "m": (1, 4)}
    with pytest.raises(Exception, match="no valid value"):
        agg.axis_range(one(spark, [None, float("nan")]), None, "v").collect()
    assert agg.distinct_values(df, "v").count() == 5
    band = agg.curve_band(df.withColumn("x", F.lit(1)), "k", "x", "v").filter("k = 'm'").first()
    assert (band["mean"], band["min"], band["max"]) == (2.5, 1, 4)


def test_map_viewport_keeps_aspect(spark):
    for lons, lats in (((-100.0, -90.0), (30.0, 31.0)), ((10.0, 10.5), (40.0, 60.0))):
        df = spark.createDataFrame(list(zip(lons, lats)), "lon double, lat double")
        r = agg.map_viewport(df, None, "lon", "lat", aspect=1.6).first()
        assert (r.x1 - r.x0) / (r.y1 - r.y0) == pytest.approx(1.6)
        wx = [6378137 * math.radians(v) for v in lons]
        assert r.x0 < wx[0] and r.x1 > wx[1]


def test_interval_extent(spark):
    df = spark.createDataFrame([(0, 10.0, 20.0), (1, 0.0, 5.0)], "i int, start double, end double")
    row = agg.interval_extent(df, None).first()
    assert (row.low, row.high) == pytest.approx((-0.2, 20.2))
    times = df.select("i", *[F.expr(f"timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0,0,{c})").alias(c) for c in ("start", "end")])
    row = agg.interval_extent(times, None, order="i").first()
    assert str(row.low) == "2019-12-31 23:10:00" and str(row.high) == "2020-01-01 01:05:00"
    with pytest.raises(Exception, match="end before start"):
        agg.interval_extent(df.withColumn("end", F.lit(-1.0)), None).collect()


@pytest.mark.parametrize("max_rows", [2, 1000])
def test_labels_round_trip(spark, max_rows):
    df = spark.createDataFrame([("b", "x"), ("a", "y"), ("c", "x"), ("a", None)], "p string, q string")
    enc = fit_labels(df, ["p", "q"], max_rows)
    got = {(r.column, r.label): r.code for r in enc.collect()}
    assert got == {("p", "a"): 0, ("p", "b"): 1, ("p", "c"): 2, ("q", "x"): 0, ("q", "y"): 1}
    coded = encode_labels(df, enc, ["p", "q"])
    assert sorted(map(tuple, decode_labels(coded, enc, ["p", "q"]).collect()), key=str) == sorted(
        map(tuple, df.collect()), key=str
    )
    with pytest.raises(Exception, match="unseen label"):
        encode_labels(df.withColumn("p", F.lit("zz")), enc, "p").collect()


def test_impute_and_detect(spark):
    df = spark.createDataFrame([("1", "a"), ("?", "b"), ("4", "1d")], "m string, t string")
    assert sorted(r.m for r in impute_mean(df, "m").collect()) == [1.0, 2.5, 4.0]
    with pytest.raises(Exception, match="not a number"):
        impute_mean(df, "t").collect()
    assert text_columns(df.filter("m <> '?'")) == ["t"]


def brute_common(data):
    """Longest string among the substrings of all; of equal ones, the first in the first text."""
    if len(data) < 2:
        return ""
    parts = [{s[i:j] for i in range(len(s)) for j in range(i + 1, len(s) + 1)} for s in data]
    return min(set.intersection(*parts), key=lambda c: (-len(c), data[0].index(c)), default="")


def test_common_substring(spark):
    rng = np.random.default_rng(4)
    groups = {
        "a": ["hello world", "yellow words", "mellow wool"],
        "b": ["only one"],
        "c": ["abc", "xyz"],
        "d": ["same", "same"],
        "e": ["", "abc"],
    }
    for i in range(8):
        groups[f"r{i}"] = ["".join(rng.choice(list("abé"), 12)) for _ in range(4)]
    rows = [(k, i, s) for k, v in groups.items() for i, s in enumerate(v)]
    df = spark.createDataFrame(rows, "k string, i int, s string").repartition(5)
    got = {r.k: r.common for r in common_substring(df, "k", "s", "i").collect()}
    assert got == {k: brute_common(v) for k, v in groups.items()}
    assert common_substring(df.filter("k = 'a'"), None, "s", "i").first().common == brute_common(groups["a"])
