"""Windows over event time; each works on a batch and on a stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) of events (ts, event_type, value); with ``slide`` windows overlap."""
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    return _marked(events, late).groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, n): a user's events with less than ``gap`` between them."""
    return _marked(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once, as far back as the watermark."""
    return _marked(events, late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
