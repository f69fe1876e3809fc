import math

import pytest

from loomstat.functions.student_t import quantile, upper_tail
from loomstat.operators.inference import diff_ci_t, mean_ci_t, ttest_greater

# fixed values: the worked samples
WOMEN = [5.33, 5.33, 5.17, 5.75, 5.42, 5.42, 5.50, 5.50, 5.58, 5.33, 5.50, 5.67, 5.42, 5.25,
         6.17, 5.42, 5.33, 5.17, 5.42, 5.42, 5.42, 5.42, 5.42, 5.83, 5.33, 5.67, 5.33, 5.66,
         5.25, 5.75, 5.57, 5.35, 5.42, 5.08, 5.75, 5.33, 5.08]
MEN = [5.75, 5.92, 6.17, 6.08, 5.58, 5.92, 6.00, 5.75, 5.92, 5.75, 5.75, 5.83, 6.58, 6.00,
       5.75, 6.42, 6.50, 6.17, 6.00, 5.67, 5.58, 5.83, 5.58, 5.58, 6.08, 5.67, 6.00]


def heights(spark):
    rows = [("w", v) for v in WOMEN] + [("m", v - 0.45) for v in MEN]
    return spark.createDataFrame(rows, "g string, v double")


def conversions(spark):
    return spark.sql(
        """select 'A' g, double(id < 200) v from range(23739)
           union all select 'B' g, double(id < 182) v from range(22588)"""
    )


def test_distribution():
    assert quantile(0.975, 10) == pytest.approx(2.2281388520, abs=1e-10)
    assert quantile(0.025, 10) == pytest.approx(-2.2281388520, abs=1e-10)
    assert quantile(0.975, 1) == pytest.approx(math.tan(0.475 * math.pi), rel=1e-10)
    assert upper_tail(1.0, 2) == pytest.approx(0.5 - 1 / (2 * math.sqrt(3)), abs=1e-13)
    for df in (1e6, 1e9, 1e13):
        assert upper_tail(1.959963984540054, df) == pytest.approx(0.025, abs=1e-6)
    assert quantile(0.975, 1e12) == pytest.approx(1.959963984540054, abs=1e-9)
    for p in (0.6, 0.95, 0.9995):
        assert upper_tail(quantile(p, 2001), 2001) == pytest.approx(1 - p, rel=1e-9)
        assert quantile(p, 2000) == pytest.approx(quantile(p, 2001), rel=1e-5)
    assert upper_tail(40.0, 1e9) == pytest.approx(0.0, abs=1e-300)
    assert upper_tail(-1.3, 7) + upper_tail(1.3, 7) == pytest.approx(1)
    assert math.isnan(upper_tail(1, 0)) and math.isnan(quantile(0.5, 0))


def test_heights(spark):
    df = heights(spark)
    ci = {r.g: r for r in mean_ci_t(df, "g", "v").collect()}
    assert ci["w"].mean == pytest.approx(5.4529729730, abs=1e-9)
    assert ci["w"].std == pytest.approx(0.2170174344, abs=1e-9)
    assert (ci["w"].lower, ci["w"].upper) == pytest.approx((5.3806157579, 5.5253301881), abs=1e-8)
    assert (ci["m"].lower, ci["m"].upper) == pytest.approx((5.3627236562, 5.5765356031), abs=1e-8)
    d = diff_ci_t(df, None, "g", "v", "m", "w").first()
    assert (d.lower, d.upper) == pytest.approx((-0.1094182943, 0.1427316076), abs=1e-8)
    t = ttest_greater(df, None, "g", "v", "m", "w").first()
    assert (t.t, t.p_value) == pytest.approx((0.2733171525, 0.3927589166), abs=1e-8)


def test_conversions(spark):
    t = ttest_greater(conversions(spark), None, "g", "v", "A", "B").first()
    assert (t.t, t.p_value) == pytest.approx((0.4373086844, 0.3309447683), abs=1e-8)


def test_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "g string, v double")
    rows = {r.g: r for r in mean_ci_t(df, "g", "v").collect()}
    assert rows["a"].lower is None and rows["b"].n == 0 and rows["b"].mean is None
    assert ttest_greater(df, None, "g", "v", "a", "b").first().p_value is None
