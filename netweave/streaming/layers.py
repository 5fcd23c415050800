"""Layers of a stream of events, for networks over time.

The batch operators take layers (t, subject, feature, value). This makes them from a stream: sums by subject and
feature in windows of event time, each given out once its watermark has passed, so that late events within the
delay count and state stays bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_layers(events: DataFrame, time: str, subject: str, feature: str, value: str, length: str = "7 days", delay: str = "1 day") -> DataFrame:
    """(start, subject, feature, value) of a stream, or of a batch table, by windows of ``length``."""
    rows = events.select(F.col(time).cast("timestamp").alias("time"), F.col(subject).alias("subject"), F.col(feature).alias("feature"), F.col(value).alias("value"))
    sums = rows.withWatermark("time", delay).groupBy(F.window("time", length), "subject", "feature").agg(F.sum("value").alias("value"))
    return sums.select(F.col("window.start").alias("start"), "subject", "feature", "value")


def numbered(layers: DataFrame, days: int = 7) -> DataFrame:
    """(t, subject, feature, value) of a finished batch of layers, numbered from the earliest without gaps in time."""
    first = layers.agg(F.min("start").alias("first"))
    t = (F.datediff(F.to_date("start"), F.to_date("first")) / days).cast("int")
    return layers.crossJoin(F.broadcast(first)).select(t.alias("t"), "subject", "feature", "value")  # first is one row
