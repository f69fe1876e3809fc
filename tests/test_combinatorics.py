import itertools
import math

import pytest
from pyspark.sql import functions as F

from loomstat.operators import combinatorics
from loomstat.operators.combinatorics import (
    best_partitions,
    completions,
    ordered_partitions,
    partitions_of,
    score_partitions,
    set_partitions,
)


def stirling(n, m):
    if n == m:
        return 1
    if m == 0 or m > n:
        return 0
    return m * stirling(n - 1, m) + stirling(n - 1, m - 1)


def test_three_items(spark):
    got = {tuple(tuple(b) for b in r.blocks) for r in set_partitions(spark, list("ABC"), 2).collect()}
    assert got == {(("A", "B"), ("C",)), (("A",), ("B", "C")), (("A", "C"), ("B",))}
    both = [tuple(tuple(b) for b in r.blocks) for r in ordered_partitions(spark, list("ABC"), 2).collect()]
    assert len(both) == 6 and set(both) == got | {(b, a) for a, b in got}


@pytest.mark.parametrize("n, m", [(1, 1), (4, 1), (4, 4), (3, 4), (6, 3), (8, 4)])
def test_counts_are_stirling_numbers(spark, n, m):
    rows = [tuple(tuple(b) for b in r.blocks) for r in set_partitions(spark, list(range(n)), m).collect()]
    assert len(rows) == len(set(rows)) == stirling(n, m)
    for row in rows:
        assert sorted(itertools.chain(*row)) == list(range(n)) and all(row)
        assert [b[0] for b in row] == sorted(b[0] for b in row)


def test_orders(spark):
    rows = [tuple(tuple(b) for b in r.blocks) for r in ordered_partitions(spark, list("abcde"), 3).collect()]
    assert len(rows) == len(set(rows)) == stirling(5, 3) * math.factorial(3)


def test_keyed_rows(spark):
    df = spark.createDataFrame([("x", [1, 2, 3]), ("y", [7]), ("z", [])], "k string, items array<int>")
    got = partitions_of(df, "items", 2, 3).groupBy("k").count().collect()
    assert [tuple(r) for r in got] == [("x", 3)]
    with pytest.raises(Exception, match="more than 2 items"):
        partitions_of(df, "items", 2, 2).collect()


def test_large_numbers_decode(spark):
    assert completions(25, 8)[25][0] == stirling(25, 8)
    # a few hundred thousand rows, all different, spread over tasks
    out = set_partitions(spark, list(range(12)), 4)
    assert out.count() == stirling(12, 4)
    assert out.select(F.to_json("blocks")).distinct().count() == stirling(12, 4)
    with pytest.raises(ValueError):
        set_partitions(spark, list(range(60)), 12)


def test_score_partitions(spark):
    df = spark.createDataFrame(
        [("k", "a", 1.0), ("k", "a", 2.0), ("k", "b", 5.0), ("k", "c", None), ("k", None, 9.0), ("one", "a", 1.0)],
        "k string, c string, v double",
    )
    rows = score_partitions(df, "k", "c", "v", 2, 3).collect()
    got = {}
    for r in rows:
        assert r.k == "k"
        got.setdefault(r["rank"], []).append((tuple(r.categories), r.n, r.total))
    want = [
        [(("a",), 2, 3.0), (("b", "c"), 1, 5.0)], [(("a", "b"), 3, 8.0), (("c",), 0, None)], [(("a", "c"), 2, 3.0), (("b",), 1, 5.0)]
    ]
    assert sorted(sorted(x) for x in got.values()) == sorted(want)
    assert score_partitions(df.limit(0), None, "c", "v", 2, 3).count() == 0
    with pytest.raises(Exception, match="more than 2 items"):
        score_partitions(df, "k", "c", "v", 2, 2).collect()


VALUES = [("k", c, float(x)) for c, xs in {"a": [4, 9], "b": [2], "c": [7, 7, 1], "d": [5], "e": [3, 8]}.items() for x in xs]
VALUES += [("k", "d", None), ("l", "a", 1.0), ("l", "b", None), ("l", "c", 2.0), ("n", None, 3.0), ("few", "a", 3.0)]


def brute_scores(rows, key, m, agg):
    """Partitions of a key's categories as sorted blocks, with the aggregate of each block's values."""
    categories = sorted({c for k, c, _ in rows if k == key and c is not None})
    out = {}
    for of in itertools.product(range(m), repeat=len(categories)):
        if set(of) == set(range(m)):
            blocks = tuple(sorted(tuple(c for c, b in zip(categories, of, strict=True) if b == x) for x in range(m)))
            out[blocks] = [agg([v for k, c, v in rows if k == key and c in b and v is not None]) for b in blocks]
    return out


AGGREGATES = {
    "sum": lambda v: sum(v) if v else None,
    "min": lambda v: min(v, default=None),
    "max": lambda v: max(v, default=None),
    "mean": lambda v: sum(v) / len(v) if v else None,
}


@pytest.mark.parametrize("agg", AGGREGATES)
def test_scores_and_best_by_every_aggregate(spark, agg, monkeypatch):
    monkeypatch.setattr(combinatorics, "CHUNK", 4)
    df = spark.createDataFrame(VALUES, "k string, c string, v double").repartition(3)
    scored = {}
    for r in score_partitions(df, "k", "c", "v", 3, 5, agg).collect():
        scored.setdefault((r.k, r["rank"]), []).append((tuple(r.categories), r.total))
    best = {(r.k, r.place): r for r in best_partitions(df, "k", "c", "v", 3, 5, agg, 4).collect()}
    for key in ("k", "l"):
        want = brute_scores(VALUES, key, 3, AGGREGATES[agg])
        got = {tuple(sorted(b for b, _ in v)): [t for _, t in sorted(v)] for (k, _), v in scored.items() if k == key}
        assert got.keys() == want.keys() and all(got[b] == pytest.approx(want[b]) for b in want)
        costs = sorted(max(s) - min(s) for s in want.values() if None not in s)[:4]
        mine = [best[key, place] for place in range(1, len(costs) + 1)]
        assert [r.cost for r in mine] == pytest.approx(costs) and (key, len(costs) + 1) not in best
        for r in mine:
            scores = want[tuple(sorted(map(tuple, r.blocks)))]
            assert r.cost == pytest.approx(max(scores) - min(scores))
        assert mine == sorted(mine, key=lambda r: (r.cost, r["rank"]))
    assert {k for k, _ in best} <= {"k", "l"}


def test_best_of_twelve_categories(spark):
    rows = [(str(k), f"{c:02d}", float((c * c * 7 + k * 13 + c) % 101)) for k in range(3) for c in range(12)]
    df = spark.createDataFrame(rows, "k string, c string, v double")
    best = {r.k: r for r in best_partitions(df, "k", "c", "v", 3, 12).collect()}
    assert len(best) == 3
    # each key against all of its groupings
    spread = score_partitions(df, "k", "c", "v", 3, 12).groupBy("k", "rank").agg((F.max("total") - F.min("total")).alias("cost"))
    least = spread.groupBy("k").agg(F.min(F.struct("cost", "rank")).alias("least")).collect()
    assert {r.k: (r.least.cost, r.least["rank"]) for r in least} == {k: (r.cost, r["rank"]) for k, r in best.items()}
    with pytest.raises(Exception, match="more than 11 items"):
        best_partitions(df, "k", "c", "v", 4, 11).collect()
    with pytest.raises(ValueError, match="agg"):
        best_partitions(df, "k", "c", "v", 4, 12, "median")
    with pytest.raises(ValueError, match="at most"):
        best_partitions(df, "k", "c", "v", 4, 40)
    assert best_partitions(df.limit(0), None, "c", "v", 4, 12).count() == 0
    assert best_partitions(df.filter("k = '0'"), None, "c", "v", 3, 12).first().cost == best["0"].cost
