"""File listings and sizes of a folder tree, and CSV export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.plans.keys import cols


def find_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path``, ``length`` and ``modified`` of files below root whose name fits.

    Only the listing is read, never the contents. Names that start with '_' or '.' are
    skipped, folders are not listed, and local symbolic links are followed.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def folder_size(spark: SparkSession, root: str, depth: int = 0) -> DataFrame:
    """Bytes and files below root, and below its sub-folders down to ``depth`` levels.

    ``folder`` is relative to root; the row with '' is the whole tree.
    """
    files = find_files(spark, root)
    # what follows the root in the path, whatever scheme Spark puts in front
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    inside = F.substr(F.col("path"), F.instr("path", base) + len(base)) if depth else F.lit("")
    parts = F.split(inside, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    levels = F.sequence(F.lit(0), F.least(F.size(folders), F.lit(depth)))
    at = F.explode(levels)
    rows = files.select("length", folders.alias("__f"), at.alias("__level"))
    named = rows.withColumn("folder", F.array_join(F.slice("__f", F.lit(1), F.col("__level")), "/"))
    return named.groupBy("folder").agg(
        F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files")
    )


def export_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, sep: str = ",") -> None:
    """Write the columns as CSV with a header, one part file per partition."""
    chosen = df.select(*cols(list(columns))) if columns else df
    chosen.write.mode("errorifexists").options(header=True, sep=sep).csv(path)
