"""Row-wise operators on streams: read a folder as a stream, write what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def stream_folder(
    spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """Files that appear in a folder, as a stream."""
    reader = spark.readStream.format(kind).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def write_available(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> None:
    """Process everything that is available now, exactly once per checkpoint, then stop."""
    query = (
        stream.writeStream.format(kind)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
