"""Counts of events in time windows, for tables and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) of events (ts, event_type, value); a stream's windows close lateness after their end."""
    source = events.withWatermark("ts", lateness) if events.isStreaming else events
    out = source.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, n): runs of a user's events with less than gap between neighbours."""
    source = events.withWatermark("ts", lateness) if events.isStreaming else events
    out = source.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), "n")
