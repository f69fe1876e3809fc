import numpy as np
import pandas as pd
import pytest

from loomstat.functions.blockfilter import block_filter
from loomstat.operators.signals import iir_filter, welch_psd


def direct_filter(b, a, x):
    b, a = np.array(b) / a[0], np.array(a) / a[0]
    y = np.zeros(len(x))
    for n in range(len(x)):
        y[n] = sum(b[k] * x[n - k] for k in range(len(b)) if n >= k)
        y[n] -= sum(a[k] * y[n - k] for k in range(1, len(a)) if n >= k)
    return y


def direct_welch(x, fs, nperseg):
    w = np.hanning(nperseg + 1)[:-1]
    step, out = nperseg - nperseg // 2, []
    for s in range(0, len(x) - nperseg + 1, step):
        seg = x[s : s + nperseg]
        p = np.abs(np.fft.rfft((seg - seg.mean()) * w)) ** 2 / (fs * (w**2).sum())
        p[1 : (nperseg + 1) // 2] *= 2
        out.append(p)
    return np.arange(nperseg // 2 + 1) * fs / nperseg, np.mean(out, axis=0)


def frame(spark, seed=0, sizes=(("a", 900), ("b", 130), ("c", 20))):
    rng = np.random.default_rng(seed)
    pdf = pd.concat([pd.DataFrame({"k": k, "i": np.arange(n), "v": rng.normal(size=n)}) for k, n in sizes])
    return pdf, spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(5)


@pytest.mark.parametrize("nperseg, max_rows", [(64, 10_000), (33, 200)])
def test_welch(spark, nperseg, max_rows):
    pdf, df = frame(spark)
    got = welch_psd(df, "k", "i", "v", 100.0, nperseg, max_rows).toPandas().sort_values(["k", "freq"])
    for key in "ab":
        f, p = direct_welch(pdf[pdf.k == key].v.to_numpy(), 100.0, nperseg)
        part = got[got.k == key]
        np.testing.assert_allclose(part.freq, f, atol=1e-9)
        np.testing.assert_allclose(part.psd, p, rtol=1e-9)
    assert "c" not in set(got.k)


def test_welch_unkeyed_finds_tone(spark):
    n = np.arange(4096)
    df = spark.createDataFrame(pd.DataFrame({"i": n, "v": np.sin(2 * np.pi * 711 * n / 6000)}))
    got = welch_psd(df, None, "i", "v", 6000, 512, max_rows=1000).toPandas()
    assert abs(got.loc[got.psd.idxmax(), "freq"] - 711) < 6000 / 512


@pytest.mark.parametrize("b, a", [([0.2, 0.3], [1.0, -0.5]), ([2.0, 0.0, 1.0], [2.0, -1.6, 1.1]), ([0.5], [1.0]), ([1, 1, 1], [1])])
def test_block_filter_matrices(b, a):
    x = np.random.default_rng(1).normal(size=700)
    filt = block_filter(b, a)
    np.testing.assert_allclose(filt.run(x)[0], direct_filter(b, a, x), atol=1e-10)
    head, state = filt.run(x[:256])
    np.testing.assert_allclose(filt.run(x[256:], state)[0], direct_filter(b, a, x)[256:], atol=1e-10)


@pytest.mark.parametrize("block, chain, max_rows", [(16_384, 1024, 10_000), (128, 2, 200)])
def test_iir_filter_equals_sequential(spark, block, chain, max_rows):
    pdf, df = frame(spark, 3)
    b, a = [0.2, 0.3, 0.1], [1.0, -1.2, 0.6]
    got = iir_filter(df, "k", "i", "v", b, a, block, chain, max_rows).toPandas().sort_values(["k", "i"])
    assert len(got) == len(pdf)
    for key in "abc":
        want = direct_filter(b, a, pdf[pdf.k == key].v.to_numpy())
        np.testing.assert_allclose(got[got.k == key].filtered, want, atol=1e-10)
