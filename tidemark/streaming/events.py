"""Event-time windows and duplicates on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streamed_bars(ticks: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream (ticker, ts timestamp, price, event_id); a bar is final once `late` has passed."""
    order = F.struct("ts", "event_id")
    out = ticks.withWatermark("ts", late).groupBy("ticker", F.window("ts", width)).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.count("*").alias("volume"),
    )
    return out.select("ticker", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume")


def first_delivery(items: DataFrame, key: str = "id", at: str = "published_at", late: str = "3 days") -> DataFrame:
    """Items of a stream without re-deliveries of their key within `late`."""
    return items.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def sliding_counts(items: DataFrame, key: str, at: str, width: str = "1 minute", slide: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    return items.withWatermark(at, late).groupBy(key, F.window(at, width, slide)).count()
