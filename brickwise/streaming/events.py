"""An extension: event-time windows over a stream of events, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events and their values summed by window and type, on a stream or a table."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark("ts", late)
    w = F.window("ts", window)
    return stamped.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100).cast("long")).alias("cents")).select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "cents")


def stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream, a file at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
