"""Streams: ours, as natural extensions of the digest and of deduplication. The same functions take batch frames where Spark allows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weekly_digest(rows: DataFrame, ts: str, category: str, score: str, late: str = "1 day", window: str = "7 days") -> DataFrame:
    """[A62] Rows, best score and strong rows (>= .7) by week and category, late rows within the watermark."""
    w = rows.withWatermark(ts, late) if rows.isStreaming else rows
    g = w.groupBy(F.window(ts, window).alias("w"), category).agg(F.count("*").alias("cnt"), F.max(score).alias("best"), F.count_if(F.col(score) >= 0.7).alias("n_strong"))
    return g.select(F.col("w.start").alias("week_start"), category, "cnt", "best", "n_strong")


def first_seen(rows: DataFrame, ts: str, key: Column, late: str = "1 day") -> DataFrame:
    """[A14] The first row of each key within the watermark; state goes as time passes."""
    keyed = rows.withColumn("__key", key)
    if not rows.isStreaming:
        return keyed.dropDuplicates(["__key"]).drop("__key")
    return keyed.withWatermark(ts, late).dropDuplicatesWithinWatermark(["__key"]).drop("__key")
