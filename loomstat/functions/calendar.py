"""Weeks, day numbers and exact microsecond arithmetic on wall-clock times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstat.functions.text import _c

MICROS_PER_DAY = 86_400_000_000
# fixed value: day number of 1970-01-01 when day 1 is 0000-01-01
EPOCH_DATENUM = 719529


def ntz_to_micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock time, free of the session zone."""
    ts = _c(ts).cast("timestamp_ntz")
    days = F.unix_date(ts.cast("date")).cast("long")
    clock = F.hour(ts).cast("long") * 3600 + F.minute(ts).cast("long") * 60
    second = F.extract(F.lit("SECOND"), ts)
    return days * MICROS_PER_DAY + clock * 1_000_000 + (second * 1_000_000).cast("long")


def micros_to_ntz(micros: Column | str) -> Column:
    """Inverse of :func:`ntz_to_micros`."""
    seconds = _c(micros).cast("decimal(24,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    interval = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + interval


def iso_week(d: Column | str) -> Column:
    """ISO year and week, '2018-33'."""
    d = _c(d)
    year = F.extract(F.lit("YEAROFWEEK"), d).cast("string")
    return F.concat(year, F.lit("-"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def week_to_date(week: Column | str, dow: Column | int = 1, mode: str = "monday") -> Column:
    """Date of day ``dow`` (0 = Sunday, which ends the week) in a week such as '2018-33'.

    ``mode='monday'`` counts from the first Monday of the year (days before it are
    week 0); ``mode='iso'`` reads ISO weeks. Malformed text gives NULL, and so does
    week 0 of a year that starts on a Monday.
    """
    if mode not in ("monday", "iso"):
        raise ValueError("mode must be 'monday' or 'iso'")
    week = _c(week)
    pattern = r"^(\d{4})-(\d{1,2})$"
    ok = week.rlike(pattern)
    year = F.when(ok, F.regexp_extract(week, pattern, 1)).cast("int")
    number = F.when(ok, F.regexp_extract(week, pattern, 2)).cast("int")
    dow = F.lit(dow) if isinstance(dow, int) else dow
    shift = F.when(dow == 0, 6).otherwise(dow - 1)
    january_1 = F.make_date(year, F.lit(1), F.lit(1))
    if mode == "monday":
        first = F.next_day(F.date_sub(january_1, 1), "Mon")
        fits = number.between(0, 53) & ~((number == 0) & (F.weekday(january_1) == 0))
    else:
        january_4 = F.make_date(year, F.lit(1), F.lit(4))
        first = F.date_sub(january_4, F.weekday(january_4))
        fits = number.between(1, 53)
    day = F.date_add(first, ((number - 1) * 7 + shift).cast("int"))
    return F.when(fits & dow.between(0, 6), day)


def is_week_begin(d: Column | str) -> Column:
    """True on Mondays: the seven days from here share one ISO week."""
    return F.weekday(_c(d)) == 0


def next_week_begin(d: Column | str) -> Column:
    """The first Monday after ``d``."""
    return F.next_day(_c(d), "Mon")


def is_week_end(d: Column | str) -> Column:
    """True on Sundays: the seven days up to here share one ISO week."""
    return F.weekday(_c(d)) == 6


def previous_week_end(d: Column | str) -> Column:
    """The last Sunday up to ``d``."""
    return F.date_sub(F.next_day(_c(d), "Sun"), F.lit(7))


def datenum_to_timestamp(x: Column | str) -> Column:
    """Fractional day number (day 1 is 0000-01-01) to a wall-clock time."""
    x = _c(x)
    whole = F.floor(x)
    fraction = F.round((x - whole) * MICROS_PER_DAY).cast("long")
    return micros_to_ntz((whole.cast("long") - EPOCH_DATENUM) * MICROS_PER_DAY + fraction)


def epoch_to_timestamp(seconds: Column | str) -> Column:
    """UTC seconds since 1970 to an instant."""
    return F.timestamp_micros(F.round(_c(seconds) * 1_000_000).cast("long"))
