"""Rows that share a key, and exact cuts of frequent words."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomstat.llm import lm, quality
from loomstat.llm.words import frequent

ROWS = [(1, "a b"), (1, "c d e"), (None, "x"), (None, "y"), (None, None), (2, "rare a Q"), (2, "rare a Q"), (2, "rare a Q"), (3, "a a zz")]


@pytest.fixture(scope="module")
def keyed(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("broadcast_words", [2, 100])
def test_lm_gives_every_row_its_own_scores(spark, keyed, monkeypatch, broadcast_words):
    monkeypatch.setattr(lm, "FREQUENT", broadcast_words)
    rows = lm.score_texts(keyed, F.coalesce(F.col("doc_id") != 3, F.lit(True))).collect()
    words = [(k, (t or "").lower().split() + ["\n"]) for k, t in ROWS]
    counts = Counter(w for k, ws in words if k != 3 for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    want = sorted(
        (k or 0, len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws), 9)) for k, ws in words
    )
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 9)) for r in rows)
    assert got == want and {r["train_tokens"] for r in rows} == {total}
    assert len({r["score"] for r in rows if r["doc_id"] == 2}) == 1
    # a row's score is that of the row alone under its key
    alone = {(r["n_tokens"], round(r["base_score"], 9)) for r in rows if r["doc_id"] is None}
    assert alone <= {(n, b) for _, n, _, b in want}


@pytest.mark.parametrize("most", [0, 1, 3, 7, 50, 1000])
def test_exactly_the_most_frequent_words(spark, most):
    counts = [(f"w{i:03d}", 1000 + i % 9) for i in range(90)] + [("top", 1 << 40), ("low", 1)]
    df = spark.createDataFrame(counts, "word string, n long").repartition(3)
    assert frequent(df, most) == sorted(counts, key=lambda c: (-c[1], c[0]))[:most]


def test_quality_samples_rows_not_keys(spark):
    good = [(i, f"alpha beta gamma delta {i} alpha beta") for i in range(40)]
    bad = [(100 + i, f"zzz qqq {i} zzz !!!") for i in range(40)]
    # one key holds most rows, equal ones and different ones
    hot = [(7, "alpha beta gamma delta 7 alpha beta")] * 60 + [(7, f"alpha gamma {i}") for i in range(60)] + [(None, "alpha")] * 3
    docs = spark.createDataFrame(good + bad + hot, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(7, 0), (None, 1)], "doc_id long, quality int")
    for rows in (80, 10_000):
        model = quality.learn(docs, labels, F.lit(True), sample_rows=rows)
        scored = {r["doc_id"]: r["score"] for r in quality.score(docs.filter("doc_id <> 7"), model).collect()}
        assert min(scored[i] for i, _ in good if i != 7) > max(scored[i] for i, _ in bad)
    # labels of rows outside the training set change nothing, not even the sample
    inside = F.col("doc_id") < 135
    more = labels.union(spark.createDataFrame([(i, 1) for i in range(135, 4000)], labels.schema))
    a, b = (quality.score(docs, quality.learn(docs, x, inside, sample_rows=60)).agg(F.sum("score")).first()[0] for x in (labels, more))
    assert a == pytest.approx(b, rel=1e-12)
