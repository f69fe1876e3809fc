import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstat.functions.suffixes import longest_matches
from loomstat.operators import substring
from loomstat.operators.substring import common_substring

SHORT = st.text("abé\U0001d11e", max_size=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(SHORT, SHORT), max_size=5))
def test_longest_matches_by_definition(pairs):
    for (a, b), found in zip(pairs, longest_matches(pairs), strict=True):
        assert found.tolist() == [max(n for n in range(len(a) - i + 1) if a[i : i + n] in b) for i in range(len(a))]


@pytest.mark.parametrize("a, b", [("", ""), ("", "x"), ("x", ""), ("a" * 300, "a" * 299), ("ab" * 90, "ba" * 91)])
def test_periodic_and_empty_strings(a, b):
    (found,) = longest_matches([(a, b)])
    assert found.tolist() == [max(n for n in range(len(a) - i + 1) if a[i : i + n] in b) for i in range(len(a))]


def long_texts():
    rng = np.random.default_rng(5)

    def noise(n):
        return "".join(rng.choice(list("abcdefgh "), n))

    shared = "-" + noise(700) + "-"
    return shared, [noise(at) + shared + noise(20_000 - at) for at in (3, 9_000, 19_999, 12_345)] + [shared]


def test_texts_of_twenty_thousand_characters(spark, monkeypatch):
    shared, texts = long_texts()
    rows = [(k, i, t) for k in ("p", "q") for i, t in enumerate(texts)] + [("q", 9, "no such passage - here")]
    df = spark.createDataFrame(rows, "k string, i int, s string").repartition(3)
    want = {r.k: r.common for r in common_substring(df, "k", "s", "i").collect()}
    assert want["p"] == shared and len(want["q"]) < 10
    # the same from small sorts and when every task passes its lengths on at once
    monkeypatch.setattr(substring, "SORTED_SYMBOLS", 50)
    monkeypatch.setattr(substring, "HELD_LENGTHS", 10)
    assert {r.k: r.common for r in common_substring(df, "k", "s", "i").collect()} == want


def test_hot_key_null_keys_and_repeated_rows(spark):
    rows = [(None, i, f"{i}xxabcdyy{i}") for i in range(400)] + [(1.5, i, "same") for i in range(5)] + [(2.0, 0, None), (2.0, 1, "alone")]
    df = spark.createDataFrame(rows, "k double, i int, s string").repartition(6)
    assert {r.k: r.common for r in common_substring(df, "k", "s", "i").collect()} == {None: "xxabcdyy", 1.5: "same", 2.0: ""}
    assert common_substring(df.filter("s LIKE '%abcd%'"), None, "s", "i").first().common == "xxabcdyy"
