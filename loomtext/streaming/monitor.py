"""Streaming extensions: first-seen documents, and metric windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(stream: DataFrame, time: str) -> DataFrame:
    """Watermarks take instants; a column without a zone is read in the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def first_seen(stream: DataFrame, key: str, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark; state older than that is dropped. A table
    that is no stream gives each key once."""
    if not stream.isStreaming:
        return stream.dropDuplicates([key])
    return timed(stream, time).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def metric_windows(stream: DataFrame, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(start, event_type, n, mean, least) of each event-time window."""
    w = timed(stream, "ts").withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type")
    out = w.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "mean", "least")
