"""Bursts of a stream: session windows per key, closed by a watermark. State is one window per open session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_bursts(events: DataFrame, key: str, time: str, gap: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(key, start, end, packets) of runs whose gaps stay under ``gap``; rows later than ``late`` are dropped. For streams and tables alike."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    sessions = marked.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("packets"))
    return sessions.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "packets")
