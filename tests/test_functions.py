import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from loomstat.functions import calendar as cal
from loomstat.functions import geo, signal, text
from loomstat.streaming.stateless import stream_folder, write_available
from loomstat.operators.quality import contains_ci, drop_missing


def values(spark, rows, kind, column):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], f"x {kind}").select(column).collect()]


def test_text(spark):
    numbers = [0, 1, 2, 3, 4, 11, 12, 13, 21, 101, 111, 112, 113, -1]
    want = "0th 1st 2nd 3rd 4th 11th 12th 13th 21st 101st 111th 112th 113th".split()
    assert values(spark, numbers, "long", text.ordinal("x")) == [*want, None]
    assert values(spark, ["a/b: ü.t_x  ", "½ ok"], "string", text.safe_filename("x")) == ["ab ü.t_x", "½ ok"]
    assert values(spark, ["4,1"], "string", text.decimal_comma("x")) == [4.1]
    assert values(spark, ["/a/b/c.txt", "c"], "string", text.folder_label("x")) == ["b", None]
    assert values(spark, ["1", "1d", "1e3", "", "nan"], "string", text.try_double("x"))[:4] == [1.0, None, 1000.0, None]


def test_geo(spark):
    df = spark.createDataFrame([(12.5, 41.9), (-180.0, -60.0), (0.0, 90.0)], "lon double, lat double")
    x, y = geo.gps_to_webm("lon", "lat")
    rows = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = geo.webm_to_gps("x", "y")
    got = rows.select("lon", "lat", "x", lon.alias("a"), lat.alias("b")).collect()
    assert got[2].x is None
    for r in got[:2]:
        assert (r.a, r.b) == pytest.approx((r.lon, r.lat), abs=1e-9)
    assert got[0].x == pytest.approx(6378137 * math.radians(12.5))


def test_weeks(spark):
    days = [dt.date(1990, 1, 1) + dt.timedelta(days=i) for i in range(0, 16_400, 3)]
    df = spark.createDataFrame([(d,) for d in days], "x date")
    out = df.select(
        "x", cal.iso_week("x").alias("w"), cal.is_week_begin("x").alias("b"), cal.is_week_end("x").alias("e"),
        cal.next_week_begin("x").alias("nb"), cal.previous_week_end("x").alias("pe"),
        cal.week_to_date(cal.iso_week("x"), 1, "iso").alias("m"),
        cal.week_to_date(F.date_format("x", "yyyy-'05'"), 0).alias("sun"),
    ).collect()
    for r in out:
        y, w, d = r.x.isocalendar()
        assert r.w == f"{y}-{w:02d}" and r.b == (d == 1) and r.e == (d == 7)
        assert r.nb == r.x + dt.timedelta(days=8 - d) and r.pe == r.x - dt.timedelta(days=d % 7)
        assert r.m == r.x - dt.timedelta(days=d - 1)
        assert r.sun == dt.datetime.strptime(f"{r.x.year}-05-0", "%Y-%W-%w").date()
    weeks = [f"{y}-{w}" for y in range(1990, 2035) for w in (0, 1, 9, 52, 53)]
    for dow in (0, 1, 4):
        got = values(spark, weeks, "string", cal.week_to_date("x", dow))
        for week, day in zip(weeks, got):
            year, number = map(int, week.split("-"))
            if number == 0 and dt.date(year, 1, 1).weekday() == 0:
                assert day is None
            else:
                assert day == dt.datetime.strptime(f"{week}-{dow}", "%Y-%W-%w").date(), week
    assert values(spark, ["x", "2020", "2020-99"], "string", cal.week_to_date("x")) == [None] * 3


def test_times(spark):
    assert values(spark, [735976.001453], "double", cal.datenum_to_timestamp("x")) == [dt.datetime(2015, 1, 12, 0, 2, 5, 539200)]
    moments = [dt.datetime(1905, 3, 4, 5, 6, 7, 891), dt.datetime(2020, 2, 29, 23, 59, 59, 999999)]
    assert values(spark, moments, "timestamp_ntz", cal.micros_to_ntz(cal.ntz_to_micros("x"))) == moments
    assert values(spark, [1.5], "double", F.unix_micros(cal.epoch_to_timestamp("x"))) == [1_500_000]
    assert values(spark, [8209.0, 250.0, 3000.0], "double", signal.aliased_freq("x", 6000)) == [2209.0, 250.0, 3000.0]


def test_stateless_operators_on_a_stream(spark, tables, tmp_path):
    events = tables("events")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = stream_folder(spark, f"{tmp_path}/in", events.schema, files_per_trigger=1)
    def steps(df):
        return contains_ci(drop_missing(df, "value"), "event_type", "CL").select(
            "event_id", cal.iso_week("ts").alias("week"), text.ordinal("user_id").alias("nth")
        )
    write_available(steps(stream), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = spark.read.parquet(f"{tmp_path}/out")
    want = steps(events)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
