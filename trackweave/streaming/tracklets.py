"""Tracklets over a stream of detections: session windows, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_tracklets(rows: DataFrame, key: str, time: str, gap: str, *, late: str | None = None) -> DataFrame:
    """Close a tracklet when its object has no row for ``gap``; works on tables and streams alike.

    ``late`` sets a watermark for a stream: rows later than that are dropped, and closed tracklets
    leave the state.
    """
    if late and rows.isStreaming:
        rows = rows.withWatermark(time, late)
    out = rows.groupBy(key, F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts"))
    return out.drop("session_window")


def frame_counts(rows: DataFrame, time: str, frame: str, *, late: str | None = None) -> DataFrame:
    """Detections of each fixed frame of time (tumbling windows)."""
    if late and rows.isStreaming:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(F.window(time, frame)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("frame_start"), "n")
