"""Flattening of maps, JSON texts and arrays of structs against a recursive version in plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.operators.nested import discover, flatten_discovered
from tests.conftest import plan_of


def leaves(value, path=()):
    """(path, value) of the leaves of nested dictionaries."""
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from leaves(inner, (*path, key))
    else:
        yield path, value


def test_json_with_varying_keys_equals_plain_walk(spark):
    rng = random.Random(4)
    keys = ["a", "b", "x.y", "c d", "it's", 'say "hi"', "q`t", "OBJECT<", "é"]

    def thing(depth):
        out = {}
        for key in rng.sample(keys, rng.randrange(4)):
            # the kind of a value follows from its key and depth, so that no path mixes kinds
            if depth < 2 and key in keys[:3]:
                out[key] = thing(depth + 1)
            elif key in keys[3:6]:
                out[key] = rng.choice([None, rng.randrange(9), rng.randrange(10) + 0.5])
            else:
                out[key] = rng.choice([None, "s", "t\n"])
        return out

    things = [thing(0) for _ in range(200)]
    rows = [(k, json.dumps(t)) for k, t in enumerate(things)]
    flat = flatten_discovered(spark.createDataFrame(rows, "id long, j string").repartition(5), ["j"], sep="/")
    expected, names = [], set()
    for k, t in enumerate(things):
        found = {"/".join(("j", *p)): v for p, v in leaves(t) if not isinstance(v, dict)}
        names |= set(found)
        expected.append({"id": k} | {n: v for n, v in found.items() if v is not None})
    assert set(flat.columns) == names | {"id"}
    got = [{n: v for n, v in r.asDict().items() if v is not None} for r in flat.orderBy("id").collect()]
    assert got == expected


def test_types_widen_as_stated(spark):
    rows = ['{"n":1,"m":1,"t":1,"o":{"a":1},"z":null}', '{"n":2.5,"m":2,"t":"x","o":3,"big":12345678901234567890}', "broken", None, "{}"]
    found = discover(spark.createDataFrame([(r,) for r in rows], "j string"), ["j"])["j"]
    kinds = {f.name: f.dataType.simpleString() for f in found.fields}
    assert kinds == {"n": "double", "m": "bigint", "t": "string", "o": "string", "z": "string", "big": "double"}
    out = flatten_discovered(spark.createDataFrame([(r,) for r in rows], "j string"), ["j"]).collect()
    assert [(r["j.n"], r["j.t"], r["j.o"]) for r in out] == [(1.0, "1", '{"a":1}'), (2.5, "x", "3"), (None, None, None), (None, None, None), (None, None, None)]


def test_maps_arrays_and_structs_together(spark):
    kind = "id long, m map<int,struct<a:long,b:array<string>>>, s struct<x:long,y:array<struct<p:long,q:struct<r:string>>>>, l array<map<string,double>>, plain array<long>"
    rows = [
        (1, {7: (1, ["u"]), 8: (None, None)}, (5, [(1, ("one",)), (2, None)]), [{"k": 1.0}, {"h": 2.0}], [1, 2]),
        (2, {9: (3, [])}, None, None, None),
        (3, None, (None, []), [], []),
    ]
    out = flatten_discovered(spark.createDataFrame(rows, kind))
    assert out.columns == ["id", "m.7.a", "m.7.b", "m.8.a", "m.8.b", "m.9.a", "m.9.b", "s.x", "s.y.p", "s.y.q.r", "l.h", "l.k", "plain"]
    a, b, c = out.orderBy("id").collect()
    assert a.asDict() == {
        "id": 1, "m.7.a": 1, "m.7.b": ["u"], "m.8.a": None, "m.8.b": None, "m.9.a": None, "m.9.b": None, "s.x": 5,
        "s.y.p": [1, 2], "s.y.q.r": ["one", None], "l.h": [None, 2.0], "l.k": [1.0, None], "plain": [1, 2],
    }
    assert (b["m.9.a"], b["m.9.b"], b["s.x"], b["s.y.p"], b["l.k"], b["plain"]) == (3, [], None, None, None, None)
    assert (c["m.7.a"], c["s.y.p"], c["l.h"], c["plain"]) == (None, [], [], [])


def test_found_types_serve_other_rows(spark):
    first = spark.createDataFrame([('{"a":1,"b":"x"}',)], "j string")
    found = discover(first, ["j"])
    later = flatten_discovered(spark.createDataFrame([('{"b":"y","c":2}',), (None,)], "j string"), ["j"], found=found)
    assert later.columns == ["j.a", "j.b"] and [tuple(r) for r in later.collect()] == [(None, "y"), (None, None)]


def test_names_and_limits(spark):
    def of(text, **options):
        return flatten_discovered(spark.createDataFrame([(text,)], "j string"), ["j"], **options)

    with pytest.raises(ValueError, match="one name"):
        of('{"k":1,"K":2}')
    with pytest.raises(ValueError, match="one name"):
        of('{"a.b":1,"a":{"b":2}}')
    assert of('{"a.b":1,"a":{"b":2}}', sep="/").columns == ["j/a/b", "j/a.b"]
    with pytest.raises(ValueError, match="more than"):
        of(json.dumps({str(k): k for k in range(30)}), max_columns=29)
    with pytest.raises(ValueError, match="no text columns"):
        flatten_discovered(spark.range(1), ["id"])
    assert flatten_discovered(spark.createDataFrame([], "j string, m map<string,int>"), ["j"]).collect() == []
    # nothing to discover: the schema alone decides, without a job
    assert flatten_discovered(spark.range(2).select(F.struct("id").alias("s"))).columns == ["s.id"]


def test_nothing_is_shuffled_and_texts_are_parsed_once(spark, tables):
    flat = flatten_discovered(tables("events").select("event_id", "props", F.create_map("event_type", "value").alias("m")), ["props"])
    plan = plan_of(flat)
    assert "Exchange" not in plan and "Python" not in plan
    assert plan.count("try_parse_json") + plan.count("parse_json(") <= 2 and plan.count("FileScan") == 1
    assert isinstance(flat.schema["props.k"].dataType, T.LongType)
