"""Streaming counterparts of the contingency operators over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, a: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, a, n): counts by window; rows later than the watermark are dropped, so state stays bounded."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), a).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), a, "n")


def windowed_moments(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n, mean, std, peak) by window and key."""
    v = F.col(value).cast("double")
    g = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key)
    return g.agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.max(F.abs(v)).alias("peak")).select(F.col("w.start").alias("start"), key, "n", "mean", "std", "peak")
