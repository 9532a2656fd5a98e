"""Counts kept up to date over a stream of occurrences or events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str = "event_id long, ts timestamp, user_id long, event_type string, value double, props string") -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, key, n) per tumbling window; rows later than the watermark are dropped, windows close behind it."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), key, "n")


def write_available(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is there to a Parquet table and stop; a later call goes on from the checkpoint."""
    rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
