"""Projection, validation and cleaning of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.functions.text import contains_ci_expr, strict_double, try_double
from loomstat.plans.keys import as_list, cols, q
from loomstat.plans.limits import broadcast_if_small
from loomstat.plans.scratch import freeze


def split_xy(df: DataFrame, features: Sequence[str], target: str) -> tuple[DataFrame, DataFrame]:
    """Feature and target projections of one frame."""
    return df.select(*cols(features)), df.select(q(target))


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename old to new names; names that are not there are ignored."""
    return df.withColumnsRenamed(dict(mapping))


def to_numeric(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Text columns to numbers; a text that is not a number is an error."""
    return df.withColumns({n: strict_double(q(n)) for n in as_list(columns)})


def bad_rows(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """The rows that :func:`to_numeric` would refuse."""
    bad = F.lit(False)
    for name in as_list(columns):
        bad = bad | (q(name).isNotNull() & try_double(name).isNull())
    return df.filter(bad)


def _missing(df: DataFrame, name: str) -> Column:
    if dict(df.dtypes)[name] in ("double", "float"):
        return q(name).isNull() | F.isnan(q(name))
    return q(name).isNull()


def drop_missing(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Rows whose listed columns are all neither NULL nor NaN."""
    for name in as_list(columns):
        df = df.filter(~_missing(df, name))
    return df


def _surplus(df: DataFrame, name: str) -> DataFrame:
    """One row: how many rows of a column repeat a value that another row has first.

    Texts and binaries are counted by a 64-bit hash; only values whose hash occurs again, which are few in a column
    that should be unique, are then counted themselves. Shorter values are counted at once. Both counts
    are combined map-side, so a value that fills the column is a few rows of the shuffle.
    """
    values = df.select(q(name).alias("v")).filter("v IS NOT NULL")
    if dict(df.dtypes)[name] in ("string", "binary"):
        hashed = values.select("v", F.xxhash64("v").alias("h"))
        again = freeze(hashed.groupBy(F.col("h").alias("again")).count().filter("count > 1").select("again"))
        values = hashed.join(broadcast_if_small(again), F.col("h") == F.col("again"), "left_semi").select("v")
    counted = values.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def check(
    df: DataFrame,
    rows: int | None = None,
    no_nulls: str | Sequence[str] = (),
    unique: str | Sequence[str] = (),
    columns: str | Sequence[str] = (),
    width: tuple[str, int] | None = None,
    fail: bool = False,
) -> DataFrame:
    """Report ``(check, column, failures)`` of all checks, from one aggregate over ``df``.

    ``width`` is (array column, expected size). ``rows`` reports the distance from the
    expected count. ``unique`` counts the surplus rows of repeated values, each column by a pass of its
    own over that column alone. With ``fail`` a failed check raises when the report is evaluated.
    """
    present = set(df.columns)
    plan: list[tuple[str, str, Column]] = []
    for name in as_list(columns):
        plan.append(("column", name, F.lit(0 if name in present else 1)))
    if rows is not None:
        plan.append(("rows", "", F.abs(F.count(F.lit(1)) - rows)))
    for name in as_list(no_nulls):
        plan.append(("no_nulls", name, F.count_if(_missing(df, name))))
    for name in as_list(unique):
        plan.append(("unique", name, F.lit(None)))
    if width is not None:
        plan.append(("width", width[0], F.count_if(F.size(q(width[0])) != width[1])))
    counted = df.agg(F.lit(1).alias("__one"), *[c.alias(f"__f{i}") for i, (k, _, c) in enumerate(plan) if k != "unique"])
    for i, (kind, name, _) in enumerate(plan):
        if kind == "unique":
            # one row to one row
            counted = counted.join(F.broadcast(_surplus(df, name).withColumnRenamed("surplus", f"__f{i}")))
    items = []
    for i, (kind, name, _) in enumerate(plan):
        failures = F.col(f"__f{i}").cast("long")
        if fail:
            text = F.concat(F.lit(f"check failed: {kind} {name}: "), failures.cast("string"))
            failures = F.when(failures > 0, F.raise_error(text).cast("long")).otherwise(failures)
        items.append(
            F.struct(F.lit(kind).alias("check"), F.lit(name).alias("column"), failures.alias("failures"))
        )
    return counted.select(F.inline(F.array(*items)))


def contains_ci(df: DataFrame, column: str, term: str) -> DataFrame:
    """Rows whose text holds the term, in any case; the empty term keeps every text."""
    return df.filter(contains_ci_expr(column, term))


def _repeated(df: DataFrame, text: str, usable: Column, order: Sequence[str]) -> DataFrame:
    """Add ``__seen``: an earlier usable row has the same text.

    The first place of every text that occurs more than once is an aggregate, combined map-side, and is
    looked up by each row. While those texts are few the table itself does not move.
    """
    marked = df.withColumn("__usable", usable).withColumn("__place", F.struct(*cols(order)))
    first = marked.filter("__usable").groupBy(q(text).alias("__again")).agg(
        F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__times")
    )
    first = freeze(first.filter("__times > 1").drop("__times"))
    joined = marked.join(broadcast_if_small(first), q(text) == F.col("__again"), "left")
    later = F.coalesce(F.col("__place") > F.col("__first"), F.lit(False))
    return joined.withColumn("__seen", F.col("__usable") & later).drop("__again", "__first", "__place")


def _flag_existing(df: DataFrame, text: str, existing: DataFrame | None) -> DataFrame:
    if existing is None:
        return df.withColumn("__old", F.lit(False))
    known = existing.select(existing[existing.columns[0]].alias("__known")).distinct()
    joined = df.join(broadcast_if_small(known), q(text) == F.col("__known"), "left")
    return joined.withColumn("__old", F.col("__known").isNotNull()).drop("__known")


def validate_entries(
    df: DataFrame,
    column: str,
    order: str | Sequence[str],
    upper: bool = False,
    unique: bool = True,
    max_len: int | None = None,
    exact_len: int | None = None,
    placeholder: str | None = None,
    existing: DataFrame | None = None,
) -> DataFrame:
    """Judge text entries in the given order; ``reason`` is NULL for accepted ones.

    Reasons: empty, placeholder, too_long, wrong_length, present. An entry is present when
    ``existing`` has it or an earlier accepted entry equals it. ``order`` must be unique: of rows that
    share a text and a place none counts as earlier.
    """
    text = F.coalesce(F.upper(q(column)) if upper else q(column), F.lit(""))
    reason = F.when(text == "", "empty")
    if placeholder is not None:
        reason = reason.when(text == placeholder, "placeholder")
    if max_len is not None:
        reason = reason.when(F.length(text) > max_len, "too_long")
    if exact_len is not None:
        reason = reason.when(F.length(text) != exact_len, "wrong_length")
    # judged on the text as changed above
    out = df.withColumn("reason", reason).withColumn(column, text)
    if not unique:
        return out
    out = _flag_existing(out, column, existing)
    out = _repeated(out, column, F.col("reason").isNull(), as_list(order))
    present = F.col("reason").isNull() & (F.col("__old") | F.col("__seen"))
    return out.withColumn("reason", F.when(present, "present").otherwise(F.col("reason"))).drop(
        "__old", "__seen", "__usable"
    )


def normalize_dates(
    df: DataFrame,
    column: str,
    order: str | Sequence[str],
    formats: Sequence[str],
    out_format: str = "dd MMMM yyyy",
    unique: bool = True,
    existing: DataFrame | None = None,
) -> DataFrame:
    """Dates in one text format; the first of the listed formats that fits is used.

    ``reason`` is NULL for accepted rows, else unparseable or present (as in :func:`validate_entries`).
    """
    parsed = F.coalesce(*[F.try_to_timestamp(q(column), F.lit(f)) for f in formats])
    out = df.withColumn(column, F.date_format(parsed, out_format))
    out = out.withColumn("reason", F.when(q(column).isNull(), "unparseable"))
    if not unique:
        return out
    out = _flag_existing(out, column, existing)
    out = _repeated(out, column, F.col("reason").isNull(), as_list(order))
    present = F.col("reason").isNull() & (F.col("__old") | F.col("__seen"))
    return out.withColumn("reason", F.when(present, "present").otherwise(F.col("reason"))).drop(
        "__old", "__seen", "__usable"
    )


# rows that are ordered to find the exact end of a sample
_ORDERED = 10_000


def sample_exact(df: DataFrame, n: int, seed: int, key: str | Sequence[str]) -> DataFrame:
    """Exactly n rows without replacement, the same for any partitioning.

    Rows are ranked by a hash of the unique ``key`` and taken by a filter on the hash. The n-th hash is
    found by counting the rows per leading bits, twelve bits more with each pass, until one range holds
    it among at most ten thousand rows; only those are ordered. Rows that share their hash because
    they repeat a key are interchangeable: any of them complete the sample.
    """
    names = as_list(key)
    hashed = df.withColumn("__h", F.xxhash64(F.lit(seed), *cols(names)))
    before, inside, shift = 0, None, 64
    while shift and (inside is None or inside > _ORDERED):
        rows = hashed if inside is None else hashed.filter(F.shiftright("__h", shift) == prefix)
        shift = max(shift - 12, 0)
        ranges = rows.groupBy(F.shiftright("__h", shift).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        found = sorted(ranges.collect())
        if inside is None and n > sum(r["n"] for r in found):
            raise ValueError(f"cannot take {n} of {sum(r['n'] for r in found)} rows")
        prefix, inside = 0, 0
        for r in found:
            prefix, inside = r["p"], r["n"]
            if before + inside >= n:
                break
            before += inside
    if n == 0 or not found:
        return df.limit(0)
    at = F.shiftright("__h", shift)
    sure, edge, wanted = hashed.filter(at < prefix), hashed.filter(at == prefix), n - before
    if inside <= _ORDERED:
        edge = edge.orderBy("__h", *cols(names)).limit(wanted)
    else:
        edge = _any_rows(edge, wanted)
    return sure.unionByName(edge).drop("__h")


def _any_rows(df: DataFrame, n: int) -> DataFrame:
    """n of the rows, counted per partition so that none moves."""
    placed = freeze(df.withColumn("__mid", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("__mid", 33).alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    joined = placed.join(broadcast_if_small(starts), F.shiftright("__mid", 33) == F.col("__part"))
    offset = F.col("__mid").bitwiseAND((1 << 33) - 1)
    return joined.filter(F.col("__start") + offset < n).select(*cols(df.columns))


def table_view(
    df: DataFrame, fields: Sequence[str], required: Sequence[str] = (), others: bool = False
) -> DataFrame:
    """The listed columns, or all of them with ``others``.

    All fields must be there, and a NULL in a required column raises when the row is read.
    """
    absent = [f for f in fields if f not in df.columns]
    if absent:
        raise ValueError(f"columns not in the table: {absent}")
    kinds = dict(df.dtypes)
    out = df if others else df.select(*cols(fields))
    stops = {}
    for name in required:
        stop = F.raise_error(F.lit(f"NULL in required column {name}")).cast(kinds[name])
        stops[name] = F.coalesce(q(name), stop)
    return out.withColumns(stops) if stops else out


def flatten_nested(df: DataFrame, sep: str = ".") -> DataFrame:
    """One column per leaf of nested structs, named by its path."""

    def leaves(kind: T.StructType, path: list[str], column: Column | None):
        for field in kind.fields:
            at = q(field.name) if column is None else column.getField(field.name)
            here = [*path, field.name]
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here, at)
            else:
                yield at.alias(sep.join(here))

    return df.select(*leaves(df.schema, [], None))


def series_to_rows(df: DataFrame, ids: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Value columns as rows ``(ids, index, values)``."""
    return df.unpivot(cols(as_list(ids)), cols(columns), "index", "values")

