"""Label alignment, membership and time-zone candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions.calendar import ntz_to_micros
from loomstat.functions.zones import with_utc_by_table, zone_table
from loomstat.plans.keys import as_list, cols, q
from loomstat.plans.limits import spread_small


def align_series(a: DataFrame, b: DataFrame, label: str, value: str, order: str) -> DataFrame:
    """Both series on the union of their labels, missing values as 0.

    ``a`` exists already and ``b`` is new: labels that only ``b`` has come first, then the
    labels of ``a``, each in its own order (``is_existing``, ``position``). A label that
    occurs twice in one series is an error.
    """
    sides = [
        df.select(q(label), q(value).alias("v"), q(order).alias("o"), F.lit(i).alias("s"))
        for i, df in enumerate((a, b))
    ]
    old, new = F.col("s") == 0, F.col("s") == 1
    merged = (
        sides[0]
        .unionByName(sides[1])
        .groupBy(q(label))
        .agg(
            F.max(F.when(old, F.col("v"))).alias("va"),
            F.max(F.when(new, F.col("v"))).alias("vb"),
            F.count_if(old).alias("na"),
            F.count_if(new).alias("nb"),
            F.max(F.when(old, F.col("o"))).alias("oa"),
            F.max(F.when(new, F.col("o"))).alias("ob"),
        )
    )
    twice = F.raise_error(F.concat(F.lit("label occurs twice: "), q(label).cast("string")))
    double = (F.col("na") > 1) | (F.col("nb") > 1)
    kinds = dict(merged.dtypes)

    def checked(column: Column, kind: str) -> Column:
        """In every column, so that selecting some of them does not skip the check."""
        return F.when(double, twice.cast(kind)).otherwise(column)

    return merged.select(
        q(label),
        checked(F.coalesce("va", F.lit(0)), kinds["va"]).alias("value_a"),
        checked(F.coalesce("vb", F.lit(0)), kinds["vb"]).alias("value_b"),
        checked(F.col("na") > 0, "boolean").alias("is_existing"),
        checked(F.coalesce("oa", "ob"), kinds["oa"]).alias("position"),
    )


def align_many(
    samples: DataFrame, label: str, series: str, value: str, names: Sequence[str], order: str | None = None
) -> DataFrame:
    """Any number of named series on the union of their labels, missing values as 0.

    A label that occurs twice in one series is an error. With ``order`` the column ``position`` is added,
    and ``is_existing`` for labels that the first series has; as in :func:`align_series` labels of later
    series come first: sort by ``is_existing``, then ``position`` (that of the earliest series with the label).
    """
    twice = F.raise_error(F.concat(F.lit("label occurs twice: "), q(label).cast("string")))
    counts = [F.count_if(q(series) == F.lit(n)) for n in names]
    picked = [F.max(F.when(q(series) == F.lit(n), q(value))) for n in names]
    found = samples.filter(q(series).isin(list(names))).groupBy(q(label))
    places = []
    if order is not None:
        places = [F.max(F.when(q(series) == F.lit(n), q(order))).alias(f"__o{i}") for i, n in enumerate(names)]
    wide = found.agg(
        F.greatest(*counts, F.lit(0)).alias("__most"),
        (counts[0] > 0).alias("__old"),
        *[v.alias(f"__v{i}") for i, v in enumerate(picked)],
        *places,
    )
    kinds = dict(wide.dtypes)

    def checked(column: Column, kind: str) -> Column:
        return F.when(F.col("__most") > 1, twice.cast(kind)).otherwise(column)

    out = [
        checked(F.coalesce(f"__v{i}", F.lit(0)), kinds[f"__v{i}"]).alias(n) for i, n in enumerate(names)
    ]
    if order is not None:
        first = F.coalesce(*[F.col(f"__o{i}") for i in range(len(names))])
        out += [checked(F.col("__old"), "boolean").alias("is_existing"), checked(first, kinds["__o0"]).alias("position")]
    return wide.select(q(label), *out)


def labels_not_in(a: DataFrame, b: DataFrame, label: str | Sequence[str]) -> DataFrame:
    """Rows of ``a`` whose label ``b`` does not have."""
    return a.join(b.select(*cols(as_list(label))).distinct(), as_list(label), "left_anti")


def labels_in(a: DataFrame, b: DataFrame, label: str | Sequence[str]) -> DataFrame:
    """Rows of ``a`` whose label ``b`` has."""
    return a.join(b.select(*cols(as_list(label))).distinct(), as_list(label), "left_semi")


def utc_candidates(df: DataFrame, ts: str, zone: str) -> DataFrame:
    """One row per zone that the zone text can mean.

    Adds ``equivalent_zone``, ``datetime_utc`` and ``hrs_wrt_utc`` (whole hours, cut toward
    zero). The zone list has a few thousand rows, fixed by the zone data release, so it is
    always broadcast and the rows of a large ``df`` never move.
    """
    table = F.broadcast(zone_table(df.sparkSession))
    joined = spread_small(df).join(table, q(zone) == F.col("zone_text")).drop("zone_text")
    out = with_utc_by_table(joined, q(ts), F.col("equivalent_zone"), "datetime_utc")
    hours = (ntz_to_micros(q(ts)) - ntz_to_micros("datetime_utc")) / 3_600_000_000
    return out.withColumn("hrs_wrt_utc", hours.cast("int"))


def filter_expected_zone(candidates: DataFrame, key: str | Sequence[str], text: str) -> DataFrame:
    """Zones that contain the text in any case, one per key and distinct offset.

    The first zone by name is kept. It is found by an aggregate over
    :func:`utc_candidates`, not by ranking the rows of a key.
    """
    keep = candidates.filter(F.lower("equivalent_zone").contains(text.lower()))
    names = [*as_list(key), "hrs_wrt_utc"]
    rest = [c for c in candidates.columns if c not in names]
    first = keep.groupBy(*cols(names)).agg(
        F.min_by(F.struct(*cols(rest)), F.col("equivalent_zone")).alias("__row")
    )
    return first.select(*cols(names), *[F.col("__row").getField(c).alias(c) for c in rest]).select(
        *cols(candidates.columns)
    )
