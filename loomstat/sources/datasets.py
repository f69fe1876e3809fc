"""Public dataset files described as data and cleaned by one set of operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.functions.text import decimal_comma
from loomstat.operators.encode import encode_labels, fit_labels, impute_mean, text_columns
from loomstat.operators.quality import check, rename_columns, sample_exact, split_xy, to_numeric
from loomstat.plans.keys import cols
from loomstat.sources.archives import read_zipped_csv
from loomstat.sources.delimited import read_delimited, read_whitespace


@dataclass(frozen=True)
class DatasetSpec:
    """How a file is laid out and cleaned. ``encode`` None means: detect text columns."""

    name: str
    desc: str
    columns: Sequence[str]
    layout: str = "delimited"
    sep: str = ","
    header: bool = False
    rows: int | None = None
    select: Sequence[str] | None = None
    rename: Mapping[str, str] = field(default_factory=dict)
    decimal_comma: Sequence[str] = ()
    encode: Sequence[str] | None = ()
    impute: Sequence[str] = ()

    @property
    def used(self) -> list[str]:
        return list(self.select or self.columns)


@dataclass(frozen=True)
class Dataset:
    """One dataset: features and target together, as read and as cleaned."""

    name: str
    desc: str
    raw: DataFrame
    clean: DataFrame
    features: list[str]
    target: str
    encoders: dict[str, DataFrame]

    def xy(self, raw: bool = False) -> tuple[DataFrame, DataFrame]:
        """Feature and target projections."""
        frame = self.raw if raw else self.clean
        *features, target = frame.columns
        return split_xy(frame, features, target)


def _read(spark: SparkSession, spec: DatasetSpec, path: str) -> DataFrame:
    if spec.layout == "whitespace":
        return read_whitespace(spark, path, spec.columns)
    if spec.layout == "zip":
        return read_zipped_csv(spark, path, spec.columns, spec.sep, header=spec.header)
    return read_delimited(spark, path, spec.columns, spec.sep, spec.header)


def load_dataset(
    spark: SparkSession, spec: DatasetSpec, path: str, size: int | None = None, seed: int = 0
) -> Dataset:
    """Read, check, sample, encode, impute and convert the dataset at ``path``.

    ``size`` takes that many rows, repeatably for a seed. The row count and the fitting of
    encoders are the only eager steps. A missing value in the cleaned data is an error
    when the row is read.
    """
    raw = _read(spark, spec, path).select(*cols(spec.used))
    if spec.rows is not None:
        check(raw, rows=spec.rows, fail=True).collect()
    if size is not None:
        raw = sample_exact(raw, size, seed, spec.used)
    encode = text_columns(raw) if spec.encode is None else list(spec.encode)
    clean, encoders = raw, {}
    if encode:
        table = fit_labels(raw, encode)
        encoders = {c: table.filter(F.col("column") == c).select("label", "code") for c in encode}
        clean = encode_labels(clean, table, encode)
    if spec.impute:
        clean = impute_mean(clean, spec.impute)
    if spec.decimal_comma:
        clean = clean.withColumns({c: decimal_comma(F.col(f"`{c}`")) for c in spec.decimal_comma})
    done = {*encode, *spec.impute, *spec.decimal_comma}
    clean = to_numeric(clean, [c for c in spec.used if c not in done])
    stops = {
        c: F.coalesce(F.col(f"`{c}`"), F.raise_error(F.lit(f"missing value in {c}")).cast(kind))
        for c, kind in clean.dtypes
    }
    clean = rename_columns(clean.withColumns(stops), spec.rename)
    return Dataset(spec.name, spec.desc, raw, clean, clean.columns[:-1], clean.columns[-1], encoders)


def _names(prefix: str, count: int, start: int = 0) -> list[str]:
    return [f"{prefix}{i}" for i in range(start, start + count)]


# fixed values: file layouts, column names and descriptions of public datasets
_DEMAND = {
    "WoM": "Week of the month (first week, second, third, fourth or fifth week",
    "DoW": "Day of the week (Monday to Friday)",
    "NUO": "Non-urgent order",
    "UO": "Urgent order",
    "OTA": "Order type A",
    "OTB": "Order type B",
    "OTC": "Order type C",
    "FSO": "Fiscal sector orders",
    "OTCS": "Orders from the traffic controller sector",
    "BO1": "Banking orders (1)",
    "BO2": "Banking orders (2)",
    "BO3": "Banking orders (3)",
}
_TRAFFIC = {
    "HR": "Hour (Coded)",
    "IB": "Immobilized bus",
    "BT": "Broken Truck",
    "VE": "Vehicle excess",
    "AV": "Accident victim",
    "RO": "Running over",
    "FV": "Fire vehicles",
    "OIF": "Occurrence involving freight",
    "IIDF": "Incident involving dangerous freight",
    "LOE": "Lack of electricity",
    "FIRE": "Fire",
    "POF": "Point of flooding",
    "MANS": "Manifestations",
    "DNT": "Defect in the network of trolleybuses",
    "TOR": "Tree on the road",
    "SO": "Semaphore off",
    "IS": "Intermittent Semaphore",
}


def _swapped(mapping: Mapping[str, str]) -> dict[str, str]:
    return {long: short for short, long in mapping.items()}


SPECS: dict[str, DatasetSpec] = {
    s.name: s
    for s in [
        DatasetSpec(
            "DEMAND", "Daily orders of a logistics company over 60 days",
            [*_DEMAND.values(), "Target (Total orders)"], sep=";", header=True, rows=60,
            rename={**_swapped(_DEMAND), "Target (Total orders)": "Orders"},
        ),
        DatasetSpec(
            "TRAFFIC", "Urban traffic of Sao Paulo in half-hour steps over five days",
            [*_TRAFFIC.values(), "Slowness in traffic (%)"], layout="zip", sep=";", header=True, rows=135,
            rename=_swapped(_TRAFFIC), decimal_comma=["Slowness in traffic (%)"],
        ),
        DatasetSpec(
            "ADVERTISING", "Sales against advertising budgets", ["row", "TV", "radio", "newspaper", "sales"],
            header=True, select=["TV", "radio", "newspaper", "sales"],
        ),
        DatasetSpec(
            "BANKNOTE", "Wavelet features of images of genuine and forged banknotes",
            [*_names("wavelet", 4), "banknote authenticity"],
        ),
        DatasetSpec(
            "ADULT", "Census records and whether income exceeds 50k",
            ["age", "workclass", "fnlwgt", "education", "education-num", "marital-status", "occupation",
             "relationship", "race", "sex", "capital-gain", "capital-loss", "hours-per-week",
             "native-country", "income, more or less than 50k"],
            encode=None,
        ),
        DatasetSpec(
            "SKIN SEGMENTATION", "Colour values and skin class of pixels", ["B", "G", "R", "skin region"],
            layout="whitespace",
        ),
        DatasetSpec(
            "YEAST", "Localization sites of yeast proteins",
            ["Sequence Name", "mcg", "gvh", "alm", "mit", "erl", "pox", "vac", "nuc", "localization site"],
            layout="whitespace", encode=["Sequence Name", "localization site"],
        ),
        DatasetSpec(
            "WIRELESS LOCALIZATION", "Wifi signal strengths observed on a smartphone",
            [*_names("signal", 7, 1), "location index"], layout="whitespace",
        ),
        DatasetSpec(
            "ECOLI", "Localization sites of E. coli proteins",
            ["Sequence Name", "mcg", "gvh", "lip", "chg", "aac", "alm1", "alm2", "localization site"],
            layout="whitespace", encode=["Sequence Name", "localization site"],
        ),
        DatasetSpec(
            "MAMMOGRAPHIC MASS", "Mass attributes and severity",
            ["bi-rads", "age", "shape", "margin", "density", "benign or malignant"],
            impute=["bi-rads", "age", "shape", "margin", "density"],
        ),
        DatasetSpec(
            "IONOSPHERE", "Radar returns of 17 pulses and their quality",
            [f"pulse {i} {part}" for i in range(17) for part in ("real", "imag")] + ["reading good or bad"],
            encode=["reading good or bad"],
        ),
        DatasetSpec(
            "CAR EVALUATION", "Car attributes and acceptability",
            ["buying", "maint", "doors", "persons", "lug_boot", "safety", "reading good or bad"],
            encode=["buying", "maint", "doors", "persons", "lug_boot", "safety", "reading good or bad"],
        ),
    ]
}
