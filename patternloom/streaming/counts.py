"""Pair counts over streams of documents or posts.

Extractors keep no state between documents, so they apply to streaming frames
as they are; only counting is stateful.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_counts(pairs: DataFrame, keys: tuple[str, ...] = ("context", "pattern")) -> DataFrame:
    """Running counts of pairs (output mode ``update`` or ``complete``); state grows with distinct keys."""
    return pairs.groupBy(*keys).agg(F.count("*").alias("matches"))


def windowed_counts(pairs: DataFrame, time: str = "ts", width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Counts of pairs in tumbling windows; windows close ``lateness`` after their end, which bounds the state."""
    rows = pairs.withWatermark(time, lateness).groupBy(F.window(time, width).alias("w"), "context", "pattern").agg(F.count("*").alias("matches"))
    return rows.select(F.col("w.start").alias("start"), "context", "pattern", "matches")
