import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomstat.operators.windows import moving_avg, moving_std, moving_sum, true_runs, waterfall
from tests.conftest import plan_of


def series(spark, values, kind="double"):
    cast = float if kind == "double" else bool
    rows = [(i, None if v is None else cast(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"i long, v {kind}")


def test_moving_avg_known_answer(spark):
    out = moving_avg(series(spark, [0.0, 0, 1, 1, 1, 1, 0, 0]), None, "i", "v", 3).orderBy("i")
    got = [r.v_avg for r in out.collect()]
    assert got[:2] == [None, None]
    assert got[2:] == pytest.approx([1 / 3, 2 / 3, 1, 1, 2 / 3, 1 / 3])


def test_moving_avg_two_columns_and_nulls(spark):
    df = spark.createDataFrame(
        [(0, 0.0, 0.0), (1, 1.0, 1.0), (2, 1.0, 1.0), (3, 0.0, 0.0)], "i long, a double, b double"
    )
    rows = moving_avg(df, None, "i", ["a", "b"], 3).orderBy("i").collect()
    assert [(r.a_avg, r.b_avg) for r in rows[:2]] == [(None, None)] * 2
    assert [r.a_avg for r in rows[2:]] == pytest.approx([2 / 3] * 2)
    assert [r.b_avg for r in rows[2:]] == pytest.approx([2 / 3] * 2)
    out = moving_avg(series(spark, [1.0, None, 3.0, 4.0, 5.0]), None, "i", "v", 2).orderBy("i")
    assert [r.v_avg for r in out.collect()] == [None, None, None, 3.5, 4.5]


def test_window_of_one_and_longer_than_series(spark):
    df = series(spark, [1.0, float("nan"), 3.0])
    assert [r.v_std for r in moving_std(df, None, "i", "v", 1).collect()] == [None] * 3
    assert [r.v_avg for r in moving_avg(df, None, "i", "v", 1).orderBy("i").collect()] == [1.0, None, 3.0]
    assert [r.v_sum for r in moving_sum(df, None, "i", "v", 9).collect()] == [None] * 3
    with pytest.raises(ValueError):
        moving_avg(df, None, "i", "v", 0)


@pytest.mark.parametrize("max_rows", [7, 64, 10_000])
@pytest.mark.parametrize("parts", [1, 5])
def test_hot_key_blocks_equal_pandas(spark, max_rows, parts):
    rng = np.random.default_rng(3)
    n = 400
    # one key holds most rows
    pdf = pd.DataFrame(
        {"k": np.where(rng.random(n) < 0.7, 1, rng.integers(2, 9, n)), "i": rng.permutation(n), "v": rng.normal(size=n)}
    )
    df = spark.createDataFrame(pdf).repartition(parts)
    out = moving_std(moving_avg(df, "k", "i", "v", 5, max_rows), "k", "i", "v", 5, max_rows).toPandas()
    want = pdf.sort_values(["k", "i"]).copy()
    want["a"] = want.groupby("k").v.transform(lambda s: s.rolling(5).mean())
    want["s"] = want.groupby("k").v.transform(lambda s: s.rolling(5).std())
    out = out.sort_values(["k", "i"])
    assert len(out) == n
    np.testing.assert_allclose(out.v_avg.to_numpy(float), want.a.to_numpy(), atol=1e-12)
    np.testing.assert_allclose(out.v_std.to_numpy(float), want.s.to_numpy(), atol=1e-12)


def test_unkeyed_plan_has_no_single_task(spark):
    out = moving_avg(spark.range(1000).withColumn("v", F.rand(1)), None, "id", "v", 3, max_rows=100)
    assert "SinglePartition" not in plan_of(out)
    assert out.count() == 1000


def brute_runs(flags, partial):
    runs, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        if not f and start is not None:
            runs.append((start, i - 1))
            start = None
    if not partial:
        runs = [r for r in runs if r[0] > 0 and r[1] < len(flags) - 1]
    return runs


@pytest.mark.parametrize("max_rows", [2, 3, 50])
def test_true_runs(spark, max_rows):
    # fixed values: a known answer
    flags = [False, False, True, True, True, False, True, True, False, True, True]
    df = series(spark, flags, "boolean")
    for partial, want in ((False, [(2, 4), (6, 7)]), (True, [(2, 4), (6, 7), (9, 10)])):
        got = true_runs(df, None, "i", "v", partial, max_rows).orderBy("start").collect()
        assert [(r.start, r.end) for r in got] == want
    df = series(spark, [True, False, True], "boolean")
    assert true_runs(df, None, "i", "v", False, max_rows).count() == 0
    got = true_runs(df, None, "i", "v", True, max_rows).orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(0, 0), (2, 2)]


@pytest.mark.parametrize("max_rows", [4, 1000])
def test_true_runs_keyed_equals_brute_force(spark, max_rows):
    rng = np.random.default_rng(5)
    rows = []
    for key, n, p in (("a", 40, 0.8), ("b", 17, 0.5), ("c", 3, 1.0), ("d", 5, 0.0)):
        rows += [(key, i, bool(f)) for i, f in enumerate(rng.random(n) < p)]
    df = spark.createDataFrame(rows, "k string, i long, f boolean").repartition(3)
    for partial in (False, True):
        got = {(r.k, r.start, r.end) for r in true_runs(df, "k", "i", "f", partial, max_rows).collect()}
        want = set()
        for key in "abcd":
            flags = [f for k, _, f in rows if k == key]
            want |= {(key, s, e) for s, e in brute_runs(flags, partial)}
        assert got == want


@pytest.mark.parametrize("max_rows", [2, 100])
def test_waterfall(spark, max_rows):
    df = series(spark, [5.0, -2.0, 4.0, -7.0])
    rows = waterfall(df, None, "i", "v", 10.0, max_rows).orderBy("i").collect()
    assert [(r.x0, r.x1) for r in rows] == [(10, 15), (15, 13), (13, 17), (17, 10)]
    assert [r.sign for r in rows] == ["positive", "negative", "positive", "negative"]
    keyed = df.withColumn("k", F.col("i") % 2)
    rows = waterfall(keyed, "k", "i", "v", 0.0, max_rows).orderBy("i").collect()
    assert [(r.x0, r.x1) for r in rows] == [(0, 5), (0, -2), (5, 9), (-2, -9)]


@pytest.mark.parametrize("max_rows, by", [(50, "k"), (400, None), (100_000, "k")])
def test_long_windows_equal_pandas(spark, max_rows, by):
    k = 100
    rng = np.random.default_rng(k)
    n = 1500
    frame = pd.DataFrame({"k": np.where(np.arange(n) % 5 < 4, "hot", "cold"), "i": np.arange(n), "v": rng.normal(1e6, 1, n)})
    frame.loc[[3, 700, 701, 1300], "v"] = np.nan
    df = spark.createDataFrame(frame).repartition(7)
    out = moving_std(moving_avg(df, by, "i", "v", k, max_rows), by, "i", "v", k, max_rows)
    assert out.columns == ["k", "i", "v", "v_avg", "v_std"]
    got = out.toPandas().sort_values("i").reset_index(drop=True)
    for name, want in (("v_avg", np.mean), ("v_std", lambda x: np.std(x, ddof=1))):
        parts = [g["v"].rolling(k) for _, g in (frame.groupby("k") if by else [(0, frame)])]
        series = pd.concat([p.apply(want, raw=True) for p in parts]).sort_index()
        np.testing.assert_allclose(got[name].astype(float), series, rtol=1e-9)
        assert series.notna().any()
