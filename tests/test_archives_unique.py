"""Archives that are streamed, and surplus rows counted per column."""

import tracemalloc
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomstat.operators import quality
from loomstat.sources import archives
from tests.conftest import plan_of


def pack(path, rows, member="rows.csv", method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z, z.open(member, "w") as out:
        out.write(b"a,b\n")
        for i in range(rows):
            out.write(f"{i},text {i}\n".encode())
    return str(path)


@pytest.fixture
def tiny_values(spark):
    """Spark refuses to read a file above 1,000 bytes as one value, as it does above 2 GB without the setting."""
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    yield
    spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


@pytest.mark.parametrize("method", [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED])
def test_archives_beyond_one_value(spark, tmp_path, tiny_values, method):
    for k in range(3):
        pack(tmp_path / f"part {k} é%.zip", 30_000, method=method)
    rows = archives.read_zipped_csv(spark, f"{tmp_path}/*.zip", ["a", "b"])
    assert rows.count() == 90_000
    assert rows.distinct().count() == 30_000
    whole = spark.read.format("binaryFile").load(f"{tmp_path}/*.zip")
    with pytest.raises(Exception, match="length|exceed"):
        archives.unzip_rows(whole, ["a", "b"]).count()


def test_own_way_to_open(spark, tmp_path):
    name = pack(tmp_path / "x.zip", 5)
    files = spark.createDataFrame([("a", name), ("b", None), ("c", name)], "k string, where string")
    out = archives.unzip_files(files, ["a", "b"], path="where", open_file=lambda p: open(p, "rb"))
    assert sorted(r.b for r in out.collect()) == sorted([f"text {i}" for i in range(5)] * 2)
    empty = archives.unzip_files(files.limit(0), ["a", "b"], path="where")
    assert empty.count() == 0


def test_memory_does_not_grow_with_the_member(tmp_path):
    """An archive of 100 MB when inflated is read within a few batches' memory."""
    path = tmp_path / "big.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open("big.csv", "w") as out:
        line = b"y" * 9_998 + b",1\n"
        for _ in range(100):
            out.write(line * 100)
    tracemalloc.start()
    with archives.open_listed(f"file:{path}") as file:
        rows = sum(b.num_rows for b in archives._batches(file, ["a", "b"], ",", "UTF-8", False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 10_000
    assert peak < 24 << 20


def test_damaged_archives_raise(spark, tmp_path):
    (tmp_path / "not.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="BadZipFile|not a zip"):
        archives.read_zipped_csv(spark, f"{tmp_path}/not.zip", ["a"]).count()


def surplus(df, names):
    return {r.column: r.failures for r in quality.check(df, unique=names).collect()}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(
    st.sampled_from([None, "", "a", "A", "é", "long " * 30]), st.sampled_from([None, 0.0, -0.0, float("nan"), 1.5]),
    st.sampled_from([None, b"", b"\x00", b"a"]), st.integers(0, 9)), max_size=40))
def test_surplus_equals_distinct_counts(spark, rows):
    df = spark.createDataFrame(rows, "t string, d double, b binary, `odd.name` int")
    expected = {
        n: df.selectExpr(f"count(`{n}`) - count(distinct `{n}`) AS x").first().x for n in ("t", "d", "b", "odd.name")
    }
    assert surplus(df, ["t", "d", "b", "odd.name"]) == expected


def test_uniqueness_expands_no_rows(spark, tables):
    report = quality.check(tables("events"), rows=1000, unique=["event_id", "user_id", "event_type"], no_nulls="ts")
    assert "Expand" not in plan_of(report)
    assert [r["check"] for r in report.collect()] == ["rows", "no_nulls", "unique", "unique", "unique"]


def test_hashes_that_meet_are_counted_by_value(spark, monkeypatch):
    """Different texts under one hash are not repeats."""
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "t string")
    monkeypatch.setattr(quality.F, "xxhash64", lambda *_: quality.F.lit(7).cast("long"))
    assert surplus(df, ["t"]) == {"t": 1}


def test_failed_uniqueness_raises(spark):
    df = spark.createDataFrame([("a",), ("a",)], "t string")
    with pytest.raises(Exception, match="check failed: unique t: 1"):
        quality.check(df, unique="t", fail=True).collect()
