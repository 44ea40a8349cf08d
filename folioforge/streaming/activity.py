"""Windows over lifecycle events; the same functions for batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late) if late else e


def sessions(events: DataFrame, gap_minutes: int, late: str | None = None) -> DataFrame:
    """Runs of a user's events without a gap: user_id, start, n, total."""
    e = _timed(events, late)
    out = e.groupBy("user_id", F.session_window("ts", f"{gap_minutes} minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select("user_id", F.col("w.start").alias("start"), "n", "total")


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts per window and kind: start, event_type, n, total."""
    e = _timed(events, late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")
