"""Bars from a stream of ticks.

Ticks (symbol, ts, place, price) become H4 bars once the watermark has passed a
bar's end; a tick that is later than the watermark allows is dropped, which is
what bounds the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, lateness: str = "1 hour", length: str = "4 hours") -> DataFrame:
    """(symbol, ts, open, high, low, close, volume) in append mode."""
    order = F.struct("ts", "place")
    return (
        ticks.withWatermark("ts", lateness)
        .groupBy("symbol", F.window("ts", length).alias("w"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("volume"))
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )
