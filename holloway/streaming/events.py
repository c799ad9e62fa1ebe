"""Windowed measures of event streams; the same functions take tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """With a watermark, which takes times of a zone only."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def once(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "1 day") -> DataFrame:
    """Events without repeats of their key; on a stream, keys are forgotten when they are later than ``late``."""
    return _timed(events, time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def activity(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str | None = "1 day") -> DataFrame:
    """(start, event_type, n, total): events and their values by window and type; windows of a stream close ``late`` after their end
    (None: the stream has a watermark already)."""
    timed = _timed(events, "ts", late) if events.isStreaming and late else events
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return timed.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
