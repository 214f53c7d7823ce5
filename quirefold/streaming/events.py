"""Event streams: windows, sessions and repeated events, with late data.

The same functions work on a static table and on a stream; watermarks only
matter to the latter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, at: str, by: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per tumbling window: window_start, ``by``, n."""
    w = events.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("window_start"), *by, "n")


def sessions(events: DataFrame, at: str, by: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of events no further apart than ``gap``: by, session_start, n."""
    s = events.withWatermark(at, late).groupBy(*by, F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("n"))
    return s.select(*by, F.col("session_window.start").alias("session_start"), "n")


def first_deliveries(events: DataFrame, at: str, key: list[str], late: str = "1 hour") -> DataFrame:
    """Each event once, however often it is delivered within ``late``."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)
