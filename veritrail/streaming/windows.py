"""Event-time windows for batch and stream alike. An extension: the reference has no stream processing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, width: str, by: list[str], value: str, late: str | None = None) -> DataFrame:
    """start, keys, n and total of each window; with `late`, a watermark lets a stream close windows."""
    if late is not None:
        events = events.withWatermark(ts, late)
    out = events.groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    """Sessions of each key: events less than `gap` apart."""
    if late is not None:
        events = events.withWatermark(ts, late)
    out = events.groupBy(F.session_window(ts, gap), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")
