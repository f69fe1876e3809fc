"""Readers, writers, ranges and generators over data derived from the tables."""

from __future__ import annotations

import datetime as dt
import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from loomstat.catalog.registry import Tables, query, r
from loomstat.functions.calendar import ntz_to_micros
from loomstat.plans.scratch import work_path
from loomstat.sources import generators as gen
from loomstat.sources.archives import unzip_rows
from loomstat.sources.datasets import DatasetSpec, load_dataset
from loomstat.sources.delimited import read_delimited, read_whitespace
from loomstat.sources.files import export_csv, find_files, folder_size

CUSTOMER = ["c_custkey", "c_name", "c_mktsegment"]
CUSTOMER_SQL = "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer"


@query("s1_read_delimited", CUSTOMER_SQL)
def s1(t: Tables):
    path = work_path(t.spark, "customer-csv")
    export_csv(t.customer, path, CUSTOMER, sep=";")
    return read_delimited(t.spark, path, CUSTOMER, sep=";", header=True)


@query("s2_read_whitespace", CUSTOMER_SQL)
def s2(t: Tables):
    path = work_path(t.spark, "customer-text")
    gaps = F.repeat(F.lit(" "), (F.col("c_custkey") % 3 + 1).cast("int"))
    t.customer.select(F.concat(F.lit("\t"), "c_custkey", gaps, "c_name", gaps, "c_mktsegment", gaps)).write.text(path)
    return read_whitespace(t.spark, path, CUSTOMER)


def _zip_batches(batches):
    for batch in batches:
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("rows.csv", batch.to_csv(index=False, sep=";"))
        yield pd.DataFrame({"content": [packed.getvalue()]})


@query("s3_read_zipped_csv", CUSTOMER_SQL)
def s3(t: Tables):
    archives = t.customer.select(*CUSTOMER).mapInPandas(_zip_batches, "content binary")
    return unzip_rows(archives, CUSTOMER, sep=";")


@query("s4_find_files")
def s4(t: Tables):
    files = find_files(t.spark, t.folder, "*.parquet")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query("a4_folder_size")
def a4(t: Tables):
    return folder_size(t.spark, t.folder)


SPANS = """u AS (SELECT user_id, epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b, count(*) AS n,
           min(value) AS va, max(value) AS vb FROM events GROUP BY 1)"""


def _spans(t: Tables):
    return t.events.groupBy("user_id").agg(
        F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n"),
        F.min("value").alias("va"), F.max("value").alias("vb"),
    )


@query(
    "s5_linspace_times",
    f"""WITH {SPANS}, e AS (SELECT *, unnest(range(0, n)) AS i, greatest(n - 1, 1)::HUGEINT AS g FROM u)
        SELECT user_id, i, (a + (2 * i::HUGEINT * (b - a) + g) // (2 * g))::BIGINT AS micros FROM e""",
)
def s5(t: Tables):
    return gen.linspace_per_key(_spans(t), "a", "b", "n").select("user_id", "i", ntz_to_micros("value").alias("micros"))


@query(
    "s5_linspace_numbers",
    f"""WITH {SPANS}, e AS (SELECT *, unnest(range(0, n)) AS i FROM u)
        SELECT user_id, i, CASE WHEN n > 1 AND i = n - 1 THEN vb ELSE va + i * ((vb - va) / greatest(n - 1, 1)) END AS value FROM e""",
)
def s5n(t: Tables):
    return gen.linspace_per_key(_spans(t), "va", "vb", "n").select("user_id", "i", "value")


@query(
    "s6_arange_numbers",
    f"""WITH {SPANS}, e AS (SELECT *, unnest(range(0, ceil((vb - va) / 2.5)::BIGINT)) AS i FROM u)
        SELECT user_id, i, va + i * 2.5 AS value FROM e""",
)
def s6(t: Tables):
    return gen.grid_per_key(_spans(t), "va", "vb", 2.5).select("user_id", "i", "value")


@query(
    "s7_grid_per_key",
    f"""WITH {SPANS}, e AS (SELECT *, unnest(range(a, b, 21600000000)) AS micros FROM u)
        SELECT user_id, (micros - a) // 21600000000 AS i, micros FROM e""",
)
def s7(t: Tables):
    grid = gen.grid_per_key(_spans(t), "a", "b", dt.timedelta(hours=6))
    return grid.select("user_id", "i", ntz_to_micros("value").alias("micros"))


@query("s8_random_sum", "SELECT o_orderkey, 1 AS adds_up, 1 AS in_bounds FROM orders")
def s8(t: Tables):
    """Every order's total split at random into ten shares of 80 to 120 % of it."""
    split = gen.random_sum(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 10, seed=8, target="o_totalprice")
    total = sum((F.col(f"f{i}") for i in range(10)), F.lit(0.0))
    smallest = F.least(*[F.col(f"f{i}") for i in range(10)])
    return split.select(
        "o_orderkey",
        (F.abs(total - F.col("frac") * F.col("y")) < 1e-6).cast("int").alias("adds_up"),
        (F.col("frac").between(0.8, 1.2) & (smallest >= 0)).cast("int").alias("in_bounds"),
    )


@query("s9_blobs", "SELECT (o_orderkey % 4)::INT AS label, count(*) AS n, 1 AS spread_fits FROM orders GROUP BY 1")
def s9(t: Tables):
    points = gen.blobs(t.orders.select("o_orderkey"), "o_orderkey", features=2, centers=4, std=1.0, seed=9)
    fits = (F.abs(F.stddev("x1") - 1) < 0.2) & (F.abs(F.stddev("x2") - 1) < 0.2)
    return points.groupBy("label").agg(F.count(F.lit(1)).alias("n"), fits.cast("int").alias("spread_fits"))


# fixed values: tones of the worked example, sampled at 6000 Hz
MAGS, FREQS = [1, 2, 4, 2, 5, 3, 1], [250, 1200, 1917, 711, 2356, 2100, 8209]


@query(
    "s10_tone_mix",
    "SELECT o_orderkey, round("
    + " + ".join(f"{m} * sin(2 * pi() * {f} * (o_orderkey / 6000.0::DOUBLE))" for m, f in zip(MAGS, FREQS))
    + ", 6) + 0.0 AS y FROM orders",
)
def s10(t: Tables):
    tones = gen.tone_mix(t.orders.select("o_orderkey"), "o_orderkey", 6000, MAGS, FREQS, noise=0)
    return tones.select("o_orderkey", r("y").alias("y"))


@query(
    "s11_load_dataset",
    """SELECT p_size::DOUBLE AS size, (dense_rank() OVER (ORDER BY p_brand) - 1) AS brand, p_retailprice AS price,
              (dense_rank() OVER (ORDER BY p_type) - 1) AS p_type FROM part""",
)
def s11(t: Tables):
    path = work_path(t.spark, "part-csv")
    export_csv(t.part, path, ["p_size", "p_brand", "p_retailprice", "p_type"])
    spec = DatasetSpec(
        "PART", "parts and their type", ["p_size", "p_brand", "p_retailprice", "p_type"], header=True,
        rows=t.part.count(), rename={"p_size": "size", "p_brand": "brand", "p_retailprice": "price"}, encode=None,
    )
    return load_dataset(t.spark, spec, path).clean


@query("k1_export_csv", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def k1(t: Tables):
    path = work_path(t.spark, "orders-csv")
    export_csv(t.orders, path, ["o_orderkey", "o_orderpriority", "o_totalprice"])
    return t.spark.read.csv(path, header=True, schema="o_orderkey long, o_orderpriority string, o_totalprice double")
