"""Reliable checkpoints in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and work tables.

    ``spark.checkpoint.dir`` (or a folder already set on the context) wins. Only a
    local session without either, such as a test run, gets a temporary folder; a cluster raises.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None:
        if not configured and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="loomstat-"))
    return configured or context.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written copy.

    Used where a plan is read more than once and must be the same each time, for
    example after range partitioning, whose borders come from a sample.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
