"""Empty inputs, single rows and NULL keys."""

import pytest
from pyspark.sql import functions as F

from loomstat.operators import aggregates as agg
from loomstat.operators import inference, joins, ordering, quality, ranks, resampling, signals, windows
from loomstat.operators.encode import encode_labels, fit_labels, impute_mean
from loomstat.operators.places import nearest_place
from loomstat.operators.substring import common_substring
from loomstat.plans.positions import expand, positions


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "k string, i long, v double, t string, f boolean, g string")


@pytest.mark.parametrize("by", [None, "k"])
def test_empty_inputs(spark, empty, by):
    assert windows.moving_avg(empty, by, "i", "v", 3).count() == 0
    assert windows.true_runs(empty, by, "i", "f").count() == 0
    assert windows.waterfall(empty, by, "i", "v").count() == 0
    assert ranks.central_interval(empty, by, "v").count() == 0
    assert resampling.mean_ci_bootstrap(empty, by, "v", n=50).count() == 0
    assert resampling.permutation_test(empty, by, "g", "v", "a", "b", n=50).count() == 0
    assert signals.welch_psd(empty, by, "i", "v", nperseg=8).count() == 0
    assert signals.iir_filter(empty, by, "i", "v", [1.0], [1.0, 0.5]).count() == 0
    hist = agg.histogram(empty, by, "v", [0, 1, 2])
    assert [r.height for r in hist.collect()] == ([] if by else [0, 0])


def test_empty_tables(spark, empty):
    assert fit_labels(empty, "t").count() == 0
    assert encode_labels(empty, fit_labels(empty, "t"), "t").count() == 0
    assert impute_mean(empty, "t").count() == 0
    assert common_substring(empty, "k", "t", "i").count() == 0
    assert quality.validate_entries(empty, "t", "i").count() == 0
    assert quality.sample_exact(empty, 0, 1, "i").count() == 0
    assert ordering.first_per_group(empty, "k", "i").count() == 0
    assert joins.labels_in(empty, empty, "k").count() == 0
    assert inference.ttest_greater(empty, "k", "g", "v", "a", "b").count() == 0
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0)], "id int, lon double, lat double")
    places = spark.createDataFrame([], "place_id int, city string, state string, lon double, lat double")
    assert [r.place for r in nearest_place(points, places, 10).collect()] == [None, None]


@pytest.mark.parametrize("max_rows", [2, 100])
def test_null_keys_form_a_key(spark, max_rows):
    rows = [(None, i, float(i)) for i in range(5)] + [("a", i, float(i)) for i in range(2)]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    out = windows.moving_sum(df, "k", "i", "v", 2, max_rows).filter("k is null").orderBy("i").collect()
    assert [r.v_sum for r in out] == [None, 1, 3, 5, 7]
    placed = positions(df, ["k"], ["i"], max_rows).filter("k is null and __pos <> i")
    assert placed.count() == 0
    row = ranks.central_interval(df, "k", "v", 0.6, max_rows).filter("k is null").first()
    assert (row.lower, row.upper) == (1, 3)


def test_one_heavy_value_is_one_row(spark):
    """A value that fills most of the table neither splits wrongly nor overflows a block."""
    df = spark.range(5000).select(F.when(F.col("id") < 4000, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    row = ranks.central_interval(df, None, "v", 0.5, max_rows=100).first()
    ordered = sorted([7.0] * 4000 + [float(i) for i in range(4000, 5000)])
    assert (row.lower, row.upper) == (ordered[1250], ordered[5000 - 1250 - 1])


def test_expand(spark):
    df = spark.createDataFrame([("a", 3), ("b", 0), ("c", 70_000), ("d", -1), ("e", None)], "k string, n int")
    got = {r.k: (r.c, r.lo, r.hi) for r in expand(df, "n").groupBy("k").agg(
        F.count_distinct("i").alias("c"), F.min("i").alias("lo"), F.max("i").alias("hi")).collect()}
    assert got == {"a": (3, 0, 2), "c": (70_000, 0, 69_999)}
