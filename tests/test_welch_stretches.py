"""Spectra against segments cut one by one, at lengths around the packed stretches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.operators import signals


def averaged(x, nperseg, fs):
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    found = []
    at = 0
    while at + nperseg <= len(x):
        piece = x[at : at + nperseg]
        power = np.abs(np.fft.rfft((piece - piece.mean()) * window)) ** 2 / (fs * (window**2).sum())
        power[1 : -1 if nperseg % 2 == 0 else None] *= 2
        found.append(power)
        at += nperseg - nperseg // 2
    return np.mean(found, axis=0) if found else np.empty(0)


@pytest.mark.parametrize("nperseg, max_rows", [(2, None), (15, None), (16, 300), (64, None), (512, 700), (1001, None)])
def test_segments_across_stretches(spark, monkeypatch, nperseg, max_rows):
    """Keys shorter than a segment, as long as one, and of many stretches; even and odd lengths; split keys."""
    monkeypatch.setattr(signals, "_PACKED", 100)
    lengths = {"short": nperseg - 1, "one": nperseg, "many": 3000, "edge": 4 * nperseg}
    rng = np.random.default_rng(nperseg)
    series = {k: rng.normal(size=n) + np.arange(n) % 7 for k, n in lengths.items()}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(5)
    got = {}
    for r in signals.welch_psd(df, "k", "i", "v", 10.0, nperseg, max_rows).orderBy("k", "freq").collect():
        got.setdefault(r.k, []).append(r.psd)
    assert set(got) == {"one", "many", "edge"}
    for key, psd in got.items():
        np.testing.assert_allclose(psd, averaged(series[key], nperseg, 10.0), rtol=1e-9, atol=1e-12)


def test_a_sample_is_sent_about_once(spark):
    """Of a series of 100,000 samples in segments of 512, one sample in sixty goes to a second stretch."""
    df = spark.range(100_000).select("id", F.sin(F.col("id") / 9).alias("v"))
    out = signals.welch_psd(df, None, "id", "v", 1.0, 512)
    assert out.count() == 257
    x = np.sin(np.arange(100_000) / 9)
    psd = [r.psd for r in out.orderBy("freq").collect()]
    np.testing.assert_allclose(psd, averaged(x, 512, 1.0), rtol=1e-9, atol=1e-12)
    assert signals._PACKED // 256 >= 60


@pytest.mark.parametrize("per_batch", ["1", "10000"])
def test_missing_samples_leave_no_density(spark, monkeypatch, per_batch):
    """A hole in one stretch of many, whatever the batches; a hole behind the last whole segment does not matter."""
    monkeypatch.setattr(signals, "_PACKED", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per_batch)
    rows = [(k, i, None if i == hole else float(i % 5)) for k, hole in (("a", 40), ("b", 69)) for i in range(70)]
    out = signals.welch_psd(spark.createDataFrame(rows, "k string, i long, v double"), "k", "i", "v", 1.0, 16).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == 18
    assert {r.psd is None for r in out if r.k == "a"} == {True}
    assert {r.psd is None for r in out if r.k == "b"} == {False}
