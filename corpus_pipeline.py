"""Corpus preparation: language, near-duplicates, repeated passages, benchmark passages, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm import decontam, langid, pieces, simhash, suffixdedup
from loomstat.llm.text import fold, row_id
from loomstat.plans.limits import broadcast_if_small
from loomstat.plans.scratch import freeze, work_path
from loomstat.plans.ship import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# a passage of over 50 words has this many bytes unless its words are shorter than four letters
PASSAGE_BYTES = 240


def _named(docs: DataFrame) -> DataFrame:
    """(row, text): each row under its ``row_id``, which decides for that doc_id and text alone."""
    return docs.select(row_id(F.col("doc_id"), F.col("text")).alias("row"), "text")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is in ``gone``."""
    names = freeze(gone.select(F.col("row").alias("__gone")).distinct())
    own = row_id(docs["doc_id"], docs["text"])
    return docs.join(broadcast_if_small(names), own == F.col("__gone"), "left_anti").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters go, whatever could be learned; a NULL lang becomes the language that the text is found to be in.

    Rows of a NULL doc_id are judged like all others, equal rows alike; a lang that is there stays. Without any labelled text
    NULL langs stay NULL. An empty table gives no rows.
    """
    ship(spark)
    model = langid.learn(docs, fold(F.col("doc_id"), 5) != 0)
    kept = _without(docs, langid.identify(_named(docs), model, "row").filter("NOT has_letter"))
    found = langid.identify(_named(kept.filter("lang IS NULL")), model, "row").filter(F.col("lang_pred") != langid.UNKNOWN)
    found = freeze(found.select(F.col("row").alias("__of"), "lang_pred").distinct())
    own = row_id(kept["doc_id"], kept["text"])
    named = kept.join(broadcast_if_small(found), own == F.col("__of"), "left")
    return named.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group stays, and one of rows that agree in doc_id and text.

    NULL doc_ids come last in their group, NULL and empty texts are a group; an empty table gives no rows.
    """
    ship(spark)
    return simhash.keep_one(docs).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages of ``PASSAGE_BYTES`` or more that occur elsewhere are cut from the texts; all documents stay.

    All places of a passage are cut, those in equal rows too. NULL and empty texts stay as they are; an empty table gives no rows.
    """
    ship(spark)
    cut = suffixdedup.without_repeats(docs.select(*COLUMNS), length=PASSAGE_BYTES)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, the others stay as they are, NULL and empty texts too; equal rows are judged alike."""
    ship(spark)
    found = decontam.find_contamination(_named(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "row")
    return _without(docs, found.filter("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece numbers per document, a row for every row; NULL and empty texts have none."""
    ship(spark)
    return pieces.encode(docs, pieces.Vocabulary.load(pieces.vocabulary_path(spark)))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("benchmark", benchmark),
    ("encode", encode),
]

# texts are cut and segmented by models that SQL cannot express; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of a folder, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
