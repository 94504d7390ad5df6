"""Structured Streaming forms of the activity rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str) -> DataFrame:
    """Watermarked; a stream's event time must be a timestamp with a time zone."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late)


def rollup(events: DataFrame, size: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events and their value by window and type, a window at each ``slide`` if one is given; for batch tables the watermark has no effect."""
    return timed(events, late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return timed(events, late).dropDuplicatesWithinWatermark(["event_id"])
