"""Structured Streaming over event folders: windowed counts with a watermark, once per event id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """New Parquet files under path, as they appear."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by window and event type; an event id counts once within the watermark; later rows than that are dropped
    by the watermark, as streams must."""
    once = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    grouped = once.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_once(counts: DataFrame, target: str, checkpoint: str) -> None:
    """Process what is there and stop; started again with the same folders, it goes on where it stopped."""
    query = counts.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
