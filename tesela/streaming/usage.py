"""Usage over event time as a stream: an extension, since the original only queries rolling counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_usage(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """event_type, window, calls and value of each window; works alike on a stream and on a table.

    Events later than ``late`` behind the newest are dropped by the watermark, which also bounds the state.
    """
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("value")).select("event_type", F.col("w.start").alias("from"), F.col("w.end").alias("until"), "calls", "value")
