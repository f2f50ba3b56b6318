"""Structured Streaming jobs: an extension beyond the batch operators.

New event files are counted in event-time windows with a watermark, and new
result records are appended only if their key is not there yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.sources.sinks import append_results, missing_from


def windowed(events: DataFrame, width: str) -> DataFrame:
    """Counts and sums of events per event-time window and type; the same plan for batch and stream."""
    w = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum_value"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n", "sum_value")


def hourly_counts(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, late: str = "2 hours") -> StreamingQuery:
    """Count new Parquet files of events by hour; windows are written once they can no longer change."""
    events = spark.readStream.schema(schema).parquet(folder).withWatermark("ts", late)
    return windowed(events, "1 hour").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resumable_results(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append new result records as JSON lines, each key once, over any number of restarts."""

    def write(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(["customer_id", "order_id"])
        append_results(missing_from(fresh, batch.sparkSession, out), out)

    return spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
