"""Structured Streaming: logs that are read as they grow, and windowed metrics. Extensions beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_values(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events (ts, event_type, value) per window and type, late ones up to the watermark; batch or stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("largest"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total", "largest")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def running_means(log: DataFrame, every: int) -> DataFrame:
    """Means over blocks of `every` steps, reset at each block's end: (step, name, value)."""
    return log.groupBy(F.ceil(F.col("step") / every).cast("bigint").alias("block"), "name").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def append_results(results: DataFrame, folder: str, checkpoint: str):
    """A stream of result events into a log, one folder a batch, so that a batch that is delivered again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{folder}/batch={number}")

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
