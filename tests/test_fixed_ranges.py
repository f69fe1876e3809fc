"""Positions of oversized keys by fixed borders: nothing is written but range sizes, and only used columns are read."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstat.operators import windows
from loomstat.plans import positions as pos
from tests.conftest import plan_of


@pytest.mark.parametrize(
    "kind, values",
    [
        ("long", [None, *range(-40, 40)]),
        ("double", [None, float("-inf"), -0.5, 0.1, 1e-300, 1e300, float("inf"), float("nan")]),
        ("string", [None, "", "a", "Ä", '"', "\\", "\n", "z" * 50, "日本"]),
        ("timestamp", [None, dt.datetime(1901, 1, 1, 3), *[dt.datetime(2024, 3, 31, 1, 0, 0, u) for u in (0, 1, 999_999)]]),
        ("date", [None, dt.date(1, 1, 1), dt.date(2024, 2, 29), dt.date(9999, 12, 31)]),
        ("decimal(20,6)", [None]),
        ("binary", [None, b"", b"\x00", b"\xff\xfe"]),
        ("boolean", [None, False, True]),
    ],
)
def test_ranges_ascend_for_every_type(spark, kind, values):
    rows = [(v, i) for i, v in enumerate(values * 40)]
    df = spark.createDataFrame(rows, f"o {kind}, i long")
    out = pos.range_positions(df, [], ["o", "i"], len(rows), 7).collect()
    assert sorted(r["__pos"] for r in out) == list(range(len(rows)))
    sorted_rows = df.orderBy("o", "i").collect()
    by_position = sorted(out, key=lambda r: r["__pos"])
    assert [r.i for r in by_position] == [r.i for r in sorted_rows]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([None, "a", "b"]), st.integers(0, 60)), min_size=1, max_size=120), st.integers(1, 40))
def test_every_key_is_numbered(spark, rows, limit):
    df = spark.createDataFrame([(k, o, i) for i, (k, o) in enumerate(rows)], "k string, o long, i long")
    out = pos.range_positions(df, ["k"], ["o"], len(rows), limit).collect()
    for key in {k for k, _ in rows}:
        mine = sorted((r["__pos"], r.o) for r in out if r.k == key)
        assert [p for p, _ in mine] == list(range(len(mine)))
        assert [o for _, o in mine] == sorted(o for k, o in rows if k == key)


def test_ranges_are_even(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("o"))
    borders, n = pos.fixed_borders(df, [F.col("o")], 200_000, 50)
    sizes = df.groupBy(pos.range_of([F.col("o")], borders, n).alias("r")).count().collect()
    assert 45 <= len(sizes) <= 55
    assert max(r["count"] for r in sizes) < 2.5 * 200_000 / 50


def test_borders_are_one_constant(spark):
    df = spark.range(10_000).withColumnRenamed("id", "o")
    borders, n = pos.fixed_borders(df, [F.col("o")], 10_000, 8)
    plan = plan_of(df.select(pos.range_of([F.col("o")], borders, n).alias("r")))
    assert "from_json" not in plan and "sort_array" not in plan


def test_unused_columns_are_not_read(spark, tmp_path, monkeypatch):
    """A rolling mean over one series: the column ``bulk`` is neither checkpointed nor read when the output leaves it out."""
    path = str(tmp_path / "rows")
    rows = spark.range(5000).select("id", (F.col("id") % 97).cast("double").alias("v"), F.repeat(F.lit("x"), 500).alias("bulk"))
    rows.write.parquet(path)
    written = []
    freeze = pos.freeze
    monkeypatch.setattr(pos, "freeze", lambda frame: written.append(frame.columns) or freeze(frame))
    out = windows.moving_avg(spark.read.parquet(path), None, "id", "v", 9, max_rows=500)
    assert written == [["__range", "__start"]]
    plan = plan_of(out.select("id", "v_avg"))
    assert plan.count("FileScan parquet") == 1
    assert "bulk" not in plan
    assert out.filter("bulk is null").count() == 0 and out.count() == 5000


def test_running_total_with_ties(spark):
    """Rows that share their place: the total after each of them is one that some order of them gives."""
    rng = random.Random(5)
    rows = [(rng.randrange(30), float(rng.randrange(4))) for _ in range(900)]
    df = spark.createDataFrame(rows, "o long, v double").repartition(7)
    out = pos.running_total(df, [], ["o"], "v", "cum", "total", max_rows=40).collect()
    whole = sum(v for _, v in rows)
    assert {r.total for r in out} == {whole}
    total, expected = 0.0, []
    for o, v in sorted(rows):
        total += v
        expected.append((o, v, total))
    assert sorted((r.o, r.v, r.cum) for r in out) == sorted(expected)
