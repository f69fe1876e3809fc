"""NULL and NaN in ordered and aggregated operators; checks that selecting a column must not skip."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.functions.blockfilter import block_filter
from loomstat.functions.text import ordinal
from loomstat.operators.aggregates import interval_extent
from loomstat.operators.encode import impute_mean
from loomstat.operators.joins import align_series, labels_in, labels_not_in
from loomstat.operators.ordering import order_by_list
from loomstat.operators.windows import waterfall
from loomstat.sources.archives import _rows


@pytest.mark.parametrize("max_rows", [1, 2, 3, 100])
def test_waterfall_goes_on_behind_holes(spark, max_rows):
    rows = list(enumerate([None, float("nan"), 5.0, 1.0, None, 2.0, float("nan"), -1.0]))
    df = spark.createDataFrame(rows, "i int, d double")
    got = waterfall(df, None, "i", "d", max_rows=max_rows).orderBy("i").collect()
    assert [r.x1 for r in got] == [None, None, 5.0, 6.0, 6.0, 8.0, 8.0, 7.0]
    assert [r.x0 for r in got] == [None, None, 0.0, 5.0, None, 6.0, None, 8.0]
    assert [r.sign for r in got] == [None, None, "positive", "positive", None, "positive", None, "negative"]
    assert got[0].label is None and got[2].label == "5.00"


def test_mean_ignores_nan_and_null(spark):
    df = spark.createDataFrame([("1",), ("NaN",), (None,), ("?",), ("3",)], "m string")
    assert sorted(r.m for r in impute_mean(df, "m").collect()) == [1.0, 2.0, 2.0, 2.0, 3.0]


@pytest.mark.parametrize("column", ["low", "high"])
def test_extent_with_holes_and_its_check(spark, column):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, nan), (nan, 5.0), (None, 3.0), (2.0, None)], "start double, end double")
    assert interval_extent(df, None).select(column).first()[0] == pytest.approx(0.96 if column == "low" else 5.04)
    bad = df.union(spark.createDataFrame([(4.0, 3.0)], df.schema))
    with pytest.raises(Exception, match="end before start"):
        interval_extent(bad, None).select(column).collect()
    times = spark.sql("SELECT timestamp '2024-01-02' AS start, timestamp '2024-01-01' AS end, 1 AS o")
    with pytest.raises(Exception, match="end before start"):
        interval_extent(times, None, order="o").select(column).collect()


@pytest.mark.parametrize("column", ["value_a", "value_b", "is_existing", "position"])
def test_double_labels_raise_in_every_column(spark, column):
    a = spark.createDataFrame([("x", 1, 0), ("x", 2, 1)], "label string, v int, o int")
    with pytest.raises(Exception, match="label occurs twice"):
        align_series(a, a.limit(0), "label", "v", "o").select("label", column).collect()


def test_membership_joins_make_the_other_side_distinct(spark):
    a = spark.range(10).withColumnRenamed("id", "k")
    b = spark.createDataFrame([(3,)] * 50, "k long")
    assert [r.k for r in labels_in(a, b, "k").collect()] == [3] and labels_not_in(a, b, "k").count() == 9
    for df in (labels_in(a, b, "k"), labels_not_in(a, b, "k")):
        assert "Aggregate" in df._jdf.queryExecution().optimizedPlan().toString()


def test_order_by_list_needs_every_index(spark):
    df = spark.createDataFrame([(7,), (8,), (1,)], "i int")
    with pytest.raises(ValueError, match="each index"):
        order_by_list(df, "i", [2, 0, 1])


def test_ordinal_of_large_numbers(spark):
    df = spark.createDataFrame([(900719925474099211,), (900719925474099221,), (112,)], "n long")
    assert [r[0] for r in df.select(ordinal("n")).collect()] == ["900719925474099211th", "900719925474099221st", "112th"]


def test_header_after_blank_lines(tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("\n\na,b\n1,2\n")
    with path.open("rb") as f:
        assert list(_rows(f, ",", "utf-8", 2, True)) == [["1", "2"]]


@pytest.mark.parametrize("hole", [float("nan"), float("inf")])
@pytest.mark.parametrize("at", [0, 127, 128, 200])
def test_filter_is_causal_around_holes(hole, at):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    b, a = [0.2, 0.3], [1.0, -0.5, 0.1]
    clean, _ = block_filter(b, a).run(x)
    x[at] = hole
    out, _ = block_filter(b, a).run(x)
    assert np.allclose(out[:at], clean[:at]) and not np.isfinite(out[at:]).any()


def test_order_table_must_be_a_permutation(spark):
    from tests.conftest import plan_of

    df = spark.createDataFrame([(i, f"r{i}") for i in range(5)], "i int, name string")

    def order(rows):
        return spark.createDataFrame(rows, "position long, rank long")

    out = order_by_list(df, "i", order([(k, (3 * k) % 5) for k in range(5)]))
    assert [r["i"] for r in out.collect()] == [0, 2, 4, 1, 3] and out.columns == ["i", "name", "rank"]
    assert "LocalTableScan [__p" not in plan_of(out)
    for rows in (
        [(k, k) for k in range(4)], [(k, k) for k in range(6)], [(0, 0), (1, 1), (2, 2), (2, 3), (4, 4)], [(k + 1, k) for k in range(5)],
        [(k, 0) for k in range(5)], [(k, k + 1) for k in range(5)], [(None, 0), (1, 1), (2, 2), (3, 3), (4, 4)],
    ):
        with pytest.raises(ValueError):
            order_by_list(df, "i", order(rows))
    with pytest.raises(ValueError):
        order_by_list(df.union(df.limit(1)), "i", order([(k, k) for k in range(6)]))
    assert order_by_list(df.limit(0), "i", order([])).count() == 0
