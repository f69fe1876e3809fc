"""Flattening of nested data whose keys are known only from the rows: maps, JSON texts, arrays of structs.

What the schema tells is taken from it. The rest is read as VARIANT values, whose merged schema is one aggregate over
the table (combined map-side, a schema per column reaches the driver); a projection then takes the paths that were found.
So the table is scanned once to discover and once to flatten, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.plans.keys import q

# columns that flattening may make; more of them speak for keys that are data
MAX_COLUMNS = 2000

_QUOTED_OR_OBJECT = re.compile(r"`(?:[^`]|``)*`|OBJECT<")


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_holds_map(f.dataType) for f in kind.fields)


def _plain(column: Column, kind: T.DataType) -> Column:
    """The column with text keys in all its maps, as VARIANT objects need them."""
    if isinstance(kind, T.MapType):
        pairs = F.transform_values(column, lambda _, v: _plain(v, kind.valueType)) if _holds_map(kind.valueType) else column
        return pairs if isinstance(kind.keyType, T.StringType) else F.transform_keys(pairs, lambda k, _: k.cast("string"))
    if isinstance(kind, T.ArrayType) and _holds_map(kind):
        return F.transform(column, lambda x: _plain(x, kind.elementType))
    if isinstance(kind, T.StructType) and _holds_map(kind):
        rebuilt = F.struct(*[_plain(column.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
        return F.when(column.isNotNull(), rebuilt)
    return column


def _known(kind: T.StructType, texts: Sequence[str], path: tuple = (), column: Column | None = None) -> Iterator[tuple]:
    """(path, column, kind, dynamic) of the leaves that the schema tells; ``dynamic`` is a VARIANT of what it doesn't tell."""
    for field in kind.fields:
        at = q(field.name) if column is None else column.getField(field.name)
        here, inner = (*path, field.name), field.dataType
        if isinstance(inner, T.StructType):
            yield from _known(inner, texts, here, at)
        elif isinstance(inner, T.StringType) and ".".join(here) in texts:
            yield here, at, inner, F.try_parse_json(at)
        elif _holds_map(inner):
            yield here, at, inner, F.call_function("to_variant_object", _plain(at, inner))
        else:
            yield here, at, inner, None


def discover(df: DataFrame, json: Sequence[str] = ()) -> dict[str, T.DataType]:
    """The merged type of each column (by its dotted path) that the schema doesn't tell: maps and the JSON texts ``json``.

    Numbers widen (whole numbers and decimals of JSON to double); a path with texts beside numbers, or objects beside
    others, is text. Keys without any value other than null are texts too. Malformed JSON counts as NULL.
    """
    dynamic = [(path, kind, variant) for path, _, kind, variant in _known(df.schema, json) if variant is not None]
    absent = set(json) - {".".join(path) for path, _, _ in dynamic}
    if absent:
        raise ValueError(f"no text columns: {sorted(absent)}")
    if not dynamic:
        return {}
    row = df.agg(*[F.schema_of_variant_agg(variant).alias(f"c{k}") for k, (_, _, variant) in enumerate(dynamic)]).first()
    found = {}
    for (path, kind, _), text in zip(dynamic, row, strict=True):
        struct = _QUOTED_OR_OBJECT.sub(lambda m: "STRUCT<" if m[0] == "OBJECT<" else m[0], text)
        found[".".join(path)] = _stated(T.StructType.fromDDL(f"v {struct}")["v"].dataType, isinstance(kind, T.StringType))
    return found


def _stated(kind: T.DataType, from_json: bool) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _stated(f.dataType, from_json)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_stated(kind.elementType, from_json))
    if isinstance(kind, T.DecimalType) and from_json:
        return T.DoubleType()
    return T.StringType() if isinstance(kind, (T.VariantType, T.NullType)) else kind


def _step(key: str) -> str:
    if "'" in key and '"' in key:
        raise ValueError(f"a key with both kinds of quotes: {key}")
    return f'["{key}"]' if "'" in key else f"['{key}']"


def _array_leaves(kind: T.DataType, column: Column, path: tuple) -> Iterator[tuple[tuple, Column]]:
    """An array of structs as an array for each leaf of its elements; other arrays as they are."""
    element = kind.elementType
    if not isinstance(element, T.StructType):
        yield path, column
        return
    for field in element.fields:
        inner = column.getField(field.name)
        if isinstance(field.dataType, T.StructType):
            yield from _array_leaves(T.ArrayType(field.dataType), inner, (*path, field.name))
        else:
            yield (*path, field.name), inner


def _found_leaves(kind: T.DataType, variant: Column, path: tuple, at: str = "$") -> Iterator[tuple[tuple, Column]]:
    if isinstance(kind, T.StructType):
        for field in kind.fields:
            yield from _found_leaves(field.dataType, variant, (*path, field.name), at + _step(field.name))
        return
    value = F.variant_get(variant, at, kind.simpleString() if not isinstance(kind, T.ArrayType) else _ddl(kind))
    if isinstance(kind, T.ArrayType):
        yield from _array_leaves(kind, value, path)
    else:
        yield path, value


def _ddl(kind: T.DataType) -> str:
    """The type as text, with every field name quoted."""
    if isinstance(kind, T.StructType):
        return "struct<" + ",".join(f"`{f.name.replace('`', '``')}`:{_ddl(f.dataType)}" for f in kind.fields) + ">"
    return f"array<{_ddl(kind.elementType)}>" if isinstance(kind, T.ArrayType) else kind.simpleString()


def flatten_discovered(
    df: DataFrame, json: Sequence[str] = (), sep: str = ".", found: Mapping[str, T.DataType] | None = None, max_columns: int = MAX_COLUMNS
) -> DataFrame:
    """One column per leaf of nested structs, maps, arrays of structs and the JSON texts ``json``, named by its path.

    ``found`` is what :func:`discover` gave, of these rows unless given; passed on, it gives other rows (a stream, a later
    batch) the same columns. A key that a row lacks is NULL. An array of structs becomes an array per leaf of its
    elements, an array of other values stays. Maps have their keys as text; objects without keys give no column. Names that
    differ in case alone, or paths that give one name, are an error, and so are more than ``max_columns`` columns.
    """
    types = discover(df, json) if found is None else found
    leaves: list[tuple[tuple, Column]] = []
    variants = {}
    for path, column, kind, variant in _known(df.schema, json):
        if variant is not None:
            # a column of its own, so that a text is parsed once however many paths are taken from it
            name = f"__variant_{len(variants)}"
            variants[name] = variant
            leaves += _found_leaves(types[".".join(path)], q(name), path)
        elif isinstance(kind, T.ArrayType):
            leaves += _array_leaves(kind, column, path)
        else:
            leaves.append((path, column))
    if len(leaves) > max_columns:
        raise ValueError(f"{len(leaves)} columns, more than {max_columns}")
    named = [(sep.join(path), column) for path, column in leaves]
    seen: dict[str, str] = {}
    for name, _ in named:
        if seen.setdefault(name.lower(), name) != name or sum(n == name for n, _ in named) > 1:
            raise ValueError(f"columns of one name: {seen[name.lower()]}, {name}")
    return df.withColumns(variants).select(*[column.alias(name) for name, column in named])
