import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.functions.draws import _by_coins, draws_of_chunk, generator, hypergeometric, sums_of_chunk
from loomstat.operators.resampling import ab_report, diff_ci_bootstrap, mean_ci_bootstrap, permutation_test
from tests.test_inference_t import conversions, heights


def test_heights_intervals(spark):
    df = heights(spark)
    ci = {r.g: r for r in mean_ci_bootstrap(df, "g", "v", seed=1).collect()}
    assert (ci["w"].lower, ci["w"].upper) == pytest.approx((5.385, 5.525), abs=0.01)
    assert (ci["m"].lower, ci["m"].upper) == pytest.approx((5.373, 5.575), abs=0.01)
    d = diff_ci_bootstrap(df, None, "g", "v", "m", "w", seed=1).first()
    assert (d.lower, d.upper) == pytest.approx((-0.109, 0.142), abs=0.02)


@pytest.mark.parametrize("chunk_values", [1024, 4])
def test_heights_p_values(spark, chunk_values):
    df = heights(spark)
    one = permutation_test(df, None, "g", "v", "m", "w", seed=2, chunk_values=chunk_values).first()
    two = permutation_test(df, None, "g", "v", "m", "w", seed=2, two_sided=True, chunk_values=chunk_values).first()
    assert one.p_value == pytest.approx(0.392, abs=0.02)
    assert two.p_value == pytest.approx(0.792, abs=0.02)


def test_conversions_p_value(spark):
    out = permutation_test(conversions(spark), None, "g", "v", "A", "B", seed=3).first()
    assert out.p_value == pytest.approx(0.3126683473, abs=0.02)


def test_same_for_any_partitioning(spark):
    df = heights(spark).withColumn("k", F.col("v") > 5.4)
    got = []
    for parts in (1, 3, 16):
        rows = ab_report(df.repartition(parts), "k", "g", "v", "m", "w", n=600, seed=5, chunk_values=5)
        got.append(sorted((str(r[:3]), *[None if x is None else round(x, 9) for x in r[3:]]) for r in rows.collect()))
    assert got[0] == got[1] == got[2]
    assert len(got[0]) == 2 * 9


def test_many_distinct_values_agree_with_theory(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(10, 2, 6000)
    df = spark.createDataFrame([(float(v), "a" if i % 3 else "b") for i, v in enumerate(x)], "v double, g string")
    ci = mean_ci_bootstrap(df, None, "v", n=2000, seed=4, chunk_values=100).first()
    half = 1.96 * x.std() / np.sqrt(len(x))
    assert (ci.lower, ci.upper) == pytest.approx((x.mean() - half, x.mean() + half), abs=0.006)
    p = permutation_test(df, None, "g", "v", "a", "b", n=2000, seed=4, chunk_values=100).first().p_value
    a, b = x[np.arange(6000) % 3 > 0], x[::3]
    z = (a.mean() - b.mean()) / (x.std() * np.sqrt(1 / len(a) + 1 / len(b)))
    from loomstat.functions.student_t import upper_tail

    assert p == pytest.approx(upper_tail(z, 5998), abs=0.04)


@pytest.mark.parametrize("replace", [True, False])
@pytest.mark.parametrize("scale", [1, 50])
def test_chunks_add_up_to_one_draw(replace, scale):
    """Draws per chunk sum to the total, and sums have the moments of a whole draw."""
    weights = np.array([3, 0, 5, 8, 2]) * scale
    values = np.array([1.0, 7.0, 2.0, -1.0, 4.0])
    total, m = int(weights.sum() if replace else weights.sum() // 3), 4000
    drawn, sums = [], np.zeros(m)
    for chunk in range(5):
        left, right = [], []
        for level in range(3):
            parent = chunk >> (level + 1)
            inside = [weights[c] for c in range(5) if (c >> (level + 1)) == parent]
            low = sum(weights[c] for c in range(5) if (c >> level) == 2 * parent)
            left.append(low), right.append(sum(inside) - low)
        if weights[chunk] == 0:
            continue
        k = draws_of_chunk((1, 2), chunk, 0, np.array(left), np.array(right), total, m, replace)
        drawn.append(k)
        sums += sums_of_chunk(generator(9, chunk), values[chunk : chunk + 1], weights[chunk : chunk + 1], k, replace)
    assert (np.sum(drawn, axis=0) == total).all()
    p = weights / weights.sum()
    mean, var = p @ values, p @ values**2 - (p @ values) ** 2
    n = weights.sum()
    spread = total * var * (1 if replace else (n - total) / (n - 1))
    assert sums.mean() == pytest.approx(total * mean, abs=4 * np.sqrt(spread / m))
    assert sums.var() == pytest.approx(spread, rel=0.12)


@pytest.mark.parametrize("replace", [True, False])
@pytest.mark.parametrize("copies", [2, 40])
def test_sums_inside_a_chunk(replace, copies):
    values = np.arange(1.0, 11.0)
    counts = np.full(10, copies)
    k = np.full(5000, 5 * copies)
    k[:3] = [0, 1, 10 * copies if not replace else 3]
    sums = sums_of_chunk(generator(3), values, counts, k, replace)
    assert sums[0] == 0 and 1 <= sums[1] <= 10
    if not replace:
        assert sums[2] == pytest.approx(55 * copies)
    n, kk = 10 * copies, 5 * copies
    spread = kk * 8.25 * (1 if replace else (n - kk) / (n - 1))
    assert sums[3:].mean() == pytest.approx(5.5 * kk, abs=5 * np.sqrt(spread / 5000))
    assert sums[3:].var() == pytest.approx(spread, rel=0.12)


def test_large_population():
    k = np.full(3000, 10**9)
    drawn = hypergeometric(generator(1), 3 * 10**9, 10**9, k)
    spread = 1e9 * 0.75 * 0.25 * 3 / 4
    assert drawn.mean() == pytest.approx(0.75e9, abs=5 * np.sqrt(spread / 3000))
    assert drawn.var() == pytest.approx(spread, rel=0.12)


def test_coins_follow_the_law_of_single_draws():
    good, bad, k = 30, 20, 17
    drawn = _by_coins(generator(3), good, bad, np.full(40_000, k))
    ways = np.array([math.comb(good, x) * math.comb(bad, k - x) for x in range(k + 1)], float)
    got = np.bincount(drawn, minlength=k + 1)
    want = ways / ways.sum() * 40_000
    assert ((got - want) ** 2 / np.maximum(want, 5)).sum() < 45
    for a, b, n in ((5, 0, 3), (0, 5, 3), (4, 3, 7), (4, 3, 0)):
        x = _by_coins(generator(4), a, b, np.full(50, n))
        assert (x <= min(a, n)).all() and (n - x <= b).all()


@pytest.mark.parametrize("chunk_values", [4, 4096])
def test_results_do_not_depend_on_units(spark, monkeypatch, chunk_values):
    from loomstat.operators import resampling

    df = heights(spark)
    seen = set()
    for units in (1, 1000):
        monkeypatch.setattr(resampling, "UNITS_PER_CORE", units)
        seen.add(permutation_test(df, None, "g", "v", "m", "w", n=3100, seed=2, chunk_values=chunk_values).first().p_value)
    assert len(seen) == 1
    assert seen.pop() == pytest.approx(0.392, abs=0.03)

