"""Size limits, read from the session so that a cluster can tune them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# rows of one key that a single task may sort and window
MAX_GROUP_ROWS = 4_000_000
# a side is broadcast only when a count proves that it stays below both limits
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def _setting(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(f"spark.loomstat.{name}", str(default)))


def max_group_rows(spark: SparkSession) -> int:
    return _setting(spark, "maxGroupRows", MAX_GROUP_ROWS)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Mark ``df`` for broadcast when one measuring job proves that it is small.

    Beyond the limits the frame is returned unmarked, so that the join shuffles
    (and adaptive execution may still split a skewed side).
    """
    spark = df.sparkSession
    size = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes"),
    ).first()
    rows = _setting(spark, "broadcastRows", BROADCAST_ROWS)
    limit = _setting(spark, "broadcastBytes", BROADCAST_BYTES)
    if size["n"] <= rows and (size["bytes"] or 0) <= limit:
        return F.broadcast(df)
    return df


def spread_small(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input to all cores before work that is long per row.

    A small table is often one file and hence one task. A large scan has many tasks already
    and is returned as it is; its size is the optimizer's estimate, so nothing is run.
    """
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(parallelism) if estimate < parallelism * 16 * 1024 * 1024 else df
