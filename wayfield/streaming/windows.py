"""Event streams: windowed service intensity with late data, and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intensity(events: DataFrame, width: str = "1 day", late: str = "2 days", by: str = "event_type") -> DataFrame:
    """Events per window and kind; works on streams and on tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days", by: str = "user_id") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), by).agg(F.count("*").alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("stop"), by, "n")
