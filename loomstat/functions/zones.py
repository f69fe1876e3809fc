"""Time-zone names and conversion of local times."""

from __future__ import annotations

import struct
from collections.abc import Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.functions.calendar import ntz_to_micros
from loomstat.functions.text import _c

# fixed values: the zone that each ambiguous abbreviation stands for by default
DEFAULT_ZONES = {
    "PST": "US/Pacific",
    "JST": "Asia/Hong_Kong",
    "CST": "US/Central",
    "EDT": "America/New_York",
    "PDT": "America/Los_Angeles",
    "CEST": "Europe/Berlin",
}

# fixed value: a zone name that the JVM knows only by its other name
JVM_ALIASES = {"ROC": "Asia/Taipei"}


@lru_cache(maxsize=1)
def zone_pairs() -> tuple[tuple[str, str], ...]:
    """(text, zone) pairs: a zone name stands for itself, an abbreviation for every
    zone that ever used it. A few thousand pairs, fixed by the zone data release."""
    import pytz

    names = set(pytz.all_timezones)
    pairs = {(name, name) for name in names}
    for name in names:
        zone = pytz.timezone(name)
        changes = getattr(zone, "_transition_info", None)
        used = {str(info[2]) for info in changes} if changes else {zone.tzname(None)}
        pairs.update((abbreviation, name) for abbreviation in used if abbreviation not in names)
    return tuple(sorted(pairs))


def zone_table(spark: SparkSession) -> DataFrame:
    """:func:`zone_pairs` as a table ``(zone_text, equivalent_zone)``."""
    return spark.createDataFrame(list(zone_pairs()), "zone_text string, equivalent_zone string")


def resolve_zone(zone: Column | str, overrides: Mapping[str, str] | None = None) -> Column:
    """Known zone names unchanged, the listed abbreviations to one zone, else NULL."""
    zone = _c(zone)
    names = sorted({name for _, name in zone_pairs()})
    short = {**DEFAULT_ZONES, **(overrides or {})}
    table = F.create_map(*[F.lit(x) for item in short.items() for x in item])
    return F.when(zone.isin(names), zone).otherwise(F.try_element_at(table, zone))


def with_utc(df: DataFrame, ts: Column | str, zone: Column | str, name: str) -> DataFrame:
    """Add the UTC wall clock of a local time.

    Skipped times use the offset before the gap; of two possible readings the later one
    (standard time) is taken. The steps are separate columns, so that each of the costly
    conversions is evaluated once per row.
    """
    utc = F.lit("UTC")
    known = _c(zone)
    for other, alias in JVM_ALIASES.items():
        known = F.when(known == other, alias).otherwise(known)
    out = df.withColumn("__zone", known).withColumn("__ts", _c(ts).cast("timestamp_ntz"))
    out = out.withColumn("__first", F.convert_timezone(F.col("__zone"), utc, F.col("__ts")))
    # the offset in force a day later gives the second reading, if there is one
    out = out.withColumn("__day", F.col("__first") + F.expr("interval 1 day"))
    later = F.convert_timezone(utc, F.col("__zone"), F.col("__day"))
    out = out.withColumn("__second", F.col("__ts") - (later - F.col("__day")))
    is_reading = (F.col("__second") > F.col("__first")) & (
        F.convert_timezone(utc, F.col("__zone"), F.col("__second")) == F.col("__ts")
    )
    chosen = F.when(is_reading, F.col("__second")).otherwise(F.col("__first"))
    return out.withColumn(name, chosen).drop("__zone", "__ts", "__first", "__day", "__second")


# years whose local times are looked up; others are converted row by row
FIRST_YEAR, LAST_YEAR = 1900, 2037


def _transitions(name: str) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds at which a zone's offset changes, and the offsets in seconds (one more) around them, from its TZif file."""
    import pytz

    with pytz.open_resource(name) as file:
        raw = file.read()
    begin = 0
    for width in (4, 8):
        utc, std, leap, times, types, chars = struct.unpack(">6l", raw[begin + 20 : begin + 44])
        begin += 44
        if width == 4:
            begin += times * 5 + types * 6 + chars + leap * 8 + std + utc
    at = np.frombuffer(raw, ">i8", times, begin).astype(np.int64)
    kind = np.frombuffer(raw, np.uint8, times, begin + 8 * times)
    offset = np.array([struct.unpack(">l", raw[k : k + 4])[0] for k in range(begin + 9 * times, begin + 9 * times + 6 * types, 6)])
    return at, offset[np.concatenate(([0], kind))] if times else offset[:1]


def local_offsets(name: str) -> tuple[np.ndarray, np.ndarray]:
    """Local seconds from which an offset holds, rising, and the offsets (one more, the first holds before).

    A local time that is skipped has the offset before the gap, one that comes twice that of its second reading: either way an
    offset begins where the local clock shows after the change.
    """
    at, offset = _transitions(name)
    starts, offsets = [], [int(offset[0])]
    for when, after in zip(at.tolist(), offset[1:].tolist(), strict=True):
        if after == offsets[-1]:
            continue
        # a change that the next one overtakes is never seen on the local clock
        while starts and starts[-1] >= when + after:
            starts.pop()
            offsets.pop()
        starts.append(when + after)
        offsets.append(after)
    return np.array(starts, np.int64), np.array(offsets, np.int64)


@lru_cache(maxsize=1)
def _offset_columns() -> tuple[pa.Table, int]:
    """Per zone: pieces of equal offset, the piece in force at the start of each month, and the most changes of any month."""
    months = np.arange(f"{FIRST_YEAR}-01", f"{LAST_YEAR + 1}-02", dtype="datetime64[M]").astype("datetime64[s]").astype(np.int64)
    names, starts, offsets, pieces, most = sorted({name for _, name in zone_pairs()}), [], [], [], 0
    for name in names:
        start, offset = local_offsets(name)
        piece = np.searchsorted(start, months, side="right")
        most = max(most, int(np.diff(piece).max()))
        starts.append(start)
        offsets.append(offset.astype(np.int32))
        pieces.append(piece[:-1].astype(np.int16))
    table = {"zone": names, "starts": pa.array(starts, pa.list_(pa.int64())), "offsets": pa.array(offsets, pa.list_(pa.int32())), "pieces": pa.array(pieces, pa.list_(pa.int16()))}
    return pa.table(table), most


def with_utc_by_table(df: DataFrame, ts: Column | str, zone: Column | str, name: str) -> DataFrame:
    """As :func:`with_utc`, from a broadcast table of the zones' offsets (some 600 rows, 3 MB, fixed by the zone data release).

    A row takes the piece of its month and then compares with the few changes within the month, so no calendar is walked. Times
    outside of ``FIRST_YEAR`` to ``LAST_YEAR`` are converted as :func:`with_utc` does; unknown zones raise there.
    """
    columns, most = _offset_columns()
    table = df.sparkSession.createDataFrame(columns).withColumnRenamed("zone", "__of")
    out = df.withColumn("__local", _c(ts).cast("timestamp_ntz")).withColumn("__name", _c(zone))
    out = out.join(F.broadcast(table), F.col("__name") == F.col("__of"), "left")
    month = (F.year("__local") - FIRST_YEAR) * 12 + F.month("__local")
    inside = F.year("__local").between(FIRST_YEAR, LAST_YEAR) & F.col("__of").isNotNull()
    out = out.withColumn("__piece", F.when(inside, F.get("pieces", month - 1)))
    out = out.withColumn("__micros", ntz_to_micros("__local"))
    seconds = F.get("offsets", F.col("__piece").cast("int"))
    for k in range(1, most + 1):
        # past the last change there is no further start, and the comparison is NULL
        later = F.get("starts", F.col("__piece") + (k - 1)) * 1_000_000 <= F.col("__micros")
        seconds = F.when(later, F.get("offsets", F.col("__piece") + k)).otherwise(seconds)
    out = out.withColumn("__seconds", seconds)
    # rows that are answered by the table have no zone left to convert with
    out = with_utc(out, "__local", F.when(F.col("__piece").isNull(), F.col("__name")), "__slow")
    found = F.col("__local") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("__seconds").cast("decimal(18,6)"))
    out = out.withColumn(name, F.coalesce(found, F.col("__slow")))
    return out.drop("__local", "__name", "__of", "starts", "offsets", "pieces", "__piece", "__micros", "__seconds", "__slow")
