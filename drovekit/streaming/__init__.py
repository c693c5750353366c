"""Structured Streaming forms of the stateful operators; each also works on a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(messages: DataFrame, *, gap: str = "4 hours", late: str = "1 day") -> DataFrame:
    """user_id, started, n, total: a session ends after more than ``gap`` without a message."""
    m = messages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = m.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("user_id", F.col("w.start").alias("started"), "n", "total")


def tumbling(messages: DataFrame, *, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """event_type, started, n of each window."""
    m = messages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return m.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("started"), "n")


def first_episodes(episodes: DataFrame, *, late: str = "7 days") -> DataFrame:
    """Each episode_id once, however often it is appended within the watermark; the state is bounded by it."""
    return episodes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["episode_id"])
