"""Fixed-window rate limit and running request aggregates, for batch and stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate_limit(events: DataFrame, key: str, ts: str, width: str = "1 minute", most: int = 100, watermark: str | None = None) -> DataFrame:
    """Per key and epoch-aligned window: calls and how many are over the limit."""
    if watermark:
        events = events.withWatermark(ts, watermark)
    counted = events.groupBy(key, F.window(ts, width).alias("w")).agg(F.count("*").alias("calls"))
    return counted.select(key, F.col("w.start").alias("start"), "calls", F.greatest(F.col("calls") - most, F.lit(0)).cast("long").alias("over"))
