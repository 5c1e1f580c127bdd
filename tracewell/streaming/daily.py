"""Daily snapshots as a stream: files that arrive are appended once per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def first_of_each(stream: DataFrame, keys: list[str], event_time: str, lateness: str = "30 days") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed, so state stays bounded."""
    return stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(keys)


def append_to(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Run over all that is there, exactly once into a Parquet table."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
