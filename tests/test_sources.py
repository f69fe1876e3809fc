import datetime as dt
import math
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from loomstat.sources import datasets, generators as gen
from loomstat.sources.archives import read_zipped_csv
from loomstat.sources.delimited import read_delimited, read_whitespace
from loomstat.sources.files import export_csv, find_files, folder_size


def write(folder, name, text, encoding="utf-8"):
    path = os.path.join(str(folder), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding) as f:
        f.write(text)
    return path


def test_read_delimited(spark, tmp_path):
    good = write(tmp_path, "a.csv", "a;b;c\n1; x ;3\n4;y;6\n\n")
    df = read_delimited(spark, good, ["a", "b", "c"], ";", header=True)
    assert [tuple(r) for r in df.collect()] == [("1", "x", "3"), ("4", "y", "6")]
    for bad in ("1;2\n", "1;2;3;4\n"):
        path = write(tmp_path, f"bad{len(bad)}.csv", "a;b;c\n1;2;3\n" + bad)
        short = read_delimited(spark, path, ["a", "b", "c"], ";", header=True, select=["a"])
        with pytest.raises(Exception, match="MALFORMED|Malformed"):
            short.collect()


def test_read_whitespace(spark, tmp_path):
    path = write(tmp_path, "w.txt", "a  1\t 2\n  b 3 4 \n\n")
    assert [tuple(r) for r in read_whitespace(spark, path, ["n", "x", "y"]).collect()] == [("a", "1", "2"), ("b", "3", "4")]
    path = write(tmp_path, "w2.txt", "a 1\n")
    with pytest.raises(Exception, match="expected 3 fields"):
        read_whitespace(spark, path, ["n", "x", "y"]).collect()


def make_zip(folder, name, members):
    path = os.path.join(str(folder), name)
    with zipfile.ZipFile(path, "w") as z:
        for member, data in members.items():
            z.writestr(member, data)
    return path


def test_read_zipped_csv(spark, tmp_path):
    for i in range(3):
        make_zip(tmp_path, f"z{i}.zip", {"d.csv": f"a;b\n{i};x{i}\n9;é\n".encode("latin-1"), "readme.txt": "no"})
    df = read_zipped_csv(spark, f"{tmp_path}/*.zip", ["a", "b"], ";", "latin-1")
    assert sorted(map(tuple, df.collect())) == [("0", "x0"), ("1", "x1"), ("2", "x2"), ("9", "é"), ("9", "é"), ("9", "é")]
    make_zip(tmp_path, "two.zip", {"a.csv": "a\n", "b.csv": "a\n"})
    with pytest.raises(Exception, match="expected one csv member"):
        read_zipped_csv(spark, f"{tmp_path}/two.zip", ["a"]).collect()


def test_files_and_export(spark, tmp_path):
    write(tmp_path, "t/a.txt", "12345")
    write(tmp_path, "t/x/b.txt", "123")
    write(tmp_path, "t/x/y/c.csv", "1")
    root = f"{tmp_path}/t"
    assert find_files(spark, root, "*.txt").count() == 2
    assert [tuple(r) for r in folder_size(spark, root).collect()] == [("", 9, 3)]
    got = {r.folder: (r.bytes, r.files) for r in folder_size(spark, root, 2).collect()}
    assert got == {"": (9, 3), "x": (4, 2), "x/y": (1, 1)}
    export_csv(spark.range(3).withColumn("t", F.lit("q,z")), f"{tmp_path}/out", ["t", "id"])
    back = read_delimited(spark, f"{tmp_path}/out", ["t", "id"], header=True)
    assert sorted(r.id for r in back.collect()) == ["0", "1", "2"] and back.first().t == "q,z"


def test_ranges(spark):
    rows = [r.value for r in gen.linspace(spark, 0, 1, 5).orderBy("i").collect()]
    assert rows == [0, 0.25, 0.5, 0.75, 1]
    assert [r.value for r in gen.linspace(spark, 3, 9, 1).collect()] == [3]
    a, b = dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2)
    times = [r.value for r in gen.linspace(spark, a, b, 4).orderBy("i").collect()]
    assert times == [a, a + dt.timedelta(hours=8), a + dt.timedelta(hours=16), b]
    assert [r.value for r in gen.arange(spark, 0, 1, 0.3).orderBy("i").collect()] == pytest.approx([0, 0.3, 0.6, 0.9])
    days = gen.arange(spark, a, dt.datetime(2020, 1, 3), dt.timedelta(days=1)).orderBy("i").collect()
    assert [r.value for r in days] == [a, b]
    assert gen.arange(spark, b, a, dt.timedelta(days=1)).count() == 0
    with pytest.raises(TypeError):
        gen.linspace(spark, a, 3, 2)
    assert gen.linspace(spark, 0, 1, 200_000).count() == 200_000


def test_random_sum(spark):
    df = gen.random_sum(spark.range(200), features=10, seed=1)
    total = sum((F.col(f"f{i}") for i in range(10)), F.lit(0.0))
    bad = df.filter((F.abs(total - F.col("frac") * F.col("y")) > 1e-12) | ~F.col("frac").between(0.8, 1.2))
    assert bad.count() == 0 and df.count() == 200
    again = gen.random_sum(spark.range(200).repartition(7), features=10, seed=1)
    assert df.exceptAll(again).count() == 0
    assert gen.random_sum(spark.range(5), features=1).select((F.col("f0") - F.col("frac") * F.col("y")).alias("d")).filter("abs(d) > 1e-12").count() == 0


def test_blobs_and_tones(spark):
    df = gen.blobs(spark.range(3000), features=2, centers=3, std=1.0, seed=2)
    stats = df.groupBy("label").agg(F.count("*").alias("n"), F.stddev("x1").alias("s1"), F.stddev("x2").alias("s2")).collect()
    assert [r.n for r in stats] == [1000] * 3
    assert all(abs(r.s1 - 1) < 0.1 and abs(r.s2 - 1) < 0.1 for r in stats)
    tone = gen.tone_mix(spark.range(10), "id", 100, [2.0], [5.0], noise=0).orderBy("id").collect()
    assert [r.y for r in tone] == pytest.approx([2 * math.sin(2 * math.pi * 5 * i / 100) for i in range(10)])
    noisy = gen.tone_mix(spark.range(5000), "id", 100, [], [], noise=1.0).agg(F.stddev("y"), F.avg("y")).first()
    assert noisy[0] == pytest.approx(1, abs=0.05) and noisy[1] == pytest.approx(0, abs=0.06)


def sample_line(spec, i):
    values = []
    for column in spec.columns:
        if spec.name == "ADULT":
            numeric = column in ("age", "fnlwgt", "education-num", "capital-gain", "capital-loss", "hours-per-week")
            values.append(str(20 + i) if numeric else f"{column[:3]}{i % 3}")
        elif column in (spec.encode or ()):
            values.append(f"v{(7 - i) % 4}")
        elif column in spec.decimal_comma:
            values.append(f"{i},5")
        elif column in spec.impute:
            values.append("?" if i == 1 else str(i))
        else:
            values.append(f"{i}.25")
    return values


@pytest.mark.parametrize("name", list(datasets.SPECS))
def test_dataset_specs(spark, tmp_path, name):
    spec = datasets.SPECS[name]
    sep = {"whitespace": "  "}.get(spec.layout, spec.sep)
    lines = [sep.join(sample_line(spec, i)) for i in range(spec.rows or 9)]
    text = "\n".join(([spec.sep.join(spec.columns)] if spec.header else []) + lines) + "\n"
    if spec.layout == "zip":
        path = make_zip(tmp_path, "d.zip", {"d.csv": text})
    else:
        path = write(tmp_path, "d.txt", text)
    data = datasets.load_dataset(spark, spec, path)
    rows = data.clean.collect()
    assert len(rows) == len(lines) and all(v is not None for r in rows for v in r)
    assert all(t in ("double", "bigint") for _, t in data.clean.dtypes)
    assert data.clean.columns == [*data.features, data.target]
    x, y = data.xy()
    assert (x.columns, y.columns) == (data.features, [data.target])
    if spec.encode is None:
        assert set(data.encoders) == {c for c in spec.columns if sample_line(spec, 0)[spec.columns.index(c)][-2:].isalpha() or not sample_line(spec, 0)[spec.columns.index(c)].isdigit()}
    if spec.impute:
        mean = sum(i for i in range(9) if i != 1) / 8
        assert any(r["age"] == pytest.approx(mean) for r in rows)


def test_dataset_checks(spark, tmp_path):
    spec = datasets.SPECS["BANKNOTE"]
    path = write(tmp_path, "b.txt", "1,2,3,4,0\n1,2,3,4,x\n")
    with pytest.raises(Exception, match="not a number"):
        datasets.load_dataset(spark, spec, path).clean.collect()
    path = write(tmp_path, "c.txt", "".join(f"{i},2,3,4,0\n" for i in range(20)))
    got = datasets.load_dataset(spark, spec, path, size=7, seed=1)
    assert got.clean.count() == 7
    demand = write(tmp_path, "d.csv", ";".join(datasets.SPECS["DEMAND"].columns) + "\n")
    with pytest.raises(Exception, match="check failed: rows"):
        datasets.load_dataset(spark, datasets.SPECS["DEMAND"], demand)
