"""Session builder with the settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "loomstat", master: str | None = None, **conf: str) -> SparkSession:
    """Create or fetch a session: adaptive execution on, UTC wall clock.

    Keys in ``conf`` use underscores for dots (``spark_sql_shuffle_partitions="8"``).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # files of checkpoints go when their frames are released
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({k.replace("_", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
