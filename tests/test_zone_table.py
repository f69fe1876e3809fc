"""The table of zone offsets against the row-by-row conversion, for all zones and their changes."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.functions import zones
from tests.conftest import plan_of

EPOCH = dt.datetime(1970, 1, 1)


def both(spark, rows):
    """Rows (zone, local, by table, row by row)."""
    frame = spark.createDataFrame(rows, "zone string, local timestamp_ntz").repartition(16)
    looked = zones.with_utc_by_table(frame, "local", "zone", "table")
    return zones.with_utc(looked, "local", "zone", "walked")


def test_offsets_begin_where_the_clock_shows():
    starts, offsets = zones.local_offsets("America/New_York")
    k = int(np.searchsorted(starts, int((dt.datetime(2023, 3, 12, 3) - EPOCH).total_seconds()), side="right"))
    assert [offsets[k - 1], offsets[k], offsets[k + 1]] == [-18000, -14400, -18000]
    # clocks go forward to three and back to one
    assert [EPOCH + dt.timedelta(seconds=int(s)) for s in starts[k - 1 : k + 1]] == [dt.datetime(2023, 3, 12, 3), dt.datetime(2023, 11, 5, 1)]
    assert (np.diff(starts) > 0).all() and len(zones.local_offsets("UTC")[0]) == 0


def readings(name, seconds):
    """UTC seconds at which a zone's clock shows a local time, by trial of every offset it ever had; else those of the offset before the gap."""
    at, offsets = zones._transitions(name)

    def offset(utc):
        return int(offsets[np.searchsorted(at, utc, side="right")])

    found = [seconds - o for o in set(offsets.tolist()) if offset(seconds - o) == o]
    if found:
        return max(found)
    # skipped: some change lies between the readings by the offset before and after it
    return min(seconds - int(offsets[k]) for k in range(len(at)) if at[k] + offsets[k] <= seconds < at[k] + offsets[k + 1])


def test_all_zones_around_all_changes(spark):
    """Every change from 1900 to 2037: a second and half an hour to either side of its start, and of its end an hour or two later."""
    rows = []
    low, high = (int((dt.datetime(y, 1, 1) - EPOCH).total_seconds()) for y in (1900, 2038))
    for name in sorted({zone for _, zone in zones.zone_pairs()}):
        for start in zones.local_offsets(name)[0].tolist():
            for apart in (-7200, -3601, -3600, -1800, -1, 0, 1, 1800, 3599, 3600, 7200):
                if low <= start + apart < high:
                    rows.append((name, EPOCH + dt.timedelta(seconds=start + apart)))
        rows += [(name, dt.datetime(y, m, 15, 12, 30, 1)) for y in range(1900, 2038, 23) for m in (1, 7)]
    found = both(spark, rows).collect()
    assert len(found) == len(rows)
    wrong = [r for r in found if (r["table"] - EPOCH).total_seconds() != readings(r["zone"], (r["local"] - EPOCH).total_seconds())]
    assert wrong == []
    # the JVM has another release of the zone data, which dates some changes differently
    differ = [r for r in found if r["table"] != r["walked"]]
    assert len({r["zone"] for r in differ}) < 40 and len(differ) < 0.002 * len(found)


def test_rows_outside_of_the_table(spark):
    rows = [("Europe/Berlin", dt.datetime(y, 7, 1)) for y in (1850, 1899, 1900, 2037, 2038, 2100)]
    rows += [(None, dt.datetime(2020, 1, 1)), ("Europe/Berlin", None), ("UTC", dt.datetime(2020, 1, 1, 0, 0, 0, 1))]
    out = both(spark, rows).collect()
    assert all(r["table"] == r["walked"] for r in out) and sum(r["table"] is None for r in out) == 2
    assert out[0].asDict().keys() == {"zone", "local", "table", "walked"}


def test_no_conversion_walks_the_calendar_twice(spark):
    frame = spark.createDataFrame([("UTC", dt.datetime(2020, 1, 1))], "zone string, local timestamp_ntz")
    plan = plan_of(zones.with_utc_by_table(frame, "local", "zone", "utc"))
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("session", ["UTC", "America/New_York"])
def test_session_zone_does_not_matter(spark, session):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session)
    try:
        rows = [("Asia/Tokyo", dt.datetime(2023, 3, 12, 2, 30)), ("America/New_York", dt.datetime(2023, 11, 5, 1, 30))]
        assert sorted(r["table"] for r in both(spark, rows).collect()) == [dt.datetime(2023, 3, 11, 17, 30), dt.datetime(2023, 11, 5, 6, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
