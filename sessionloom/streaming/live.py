"""Counts over a stream of tool-call events: by windows, and by sessions that a pause ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_rates(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and failures of each kind by event-time window; rows later than ``late`` are dropped
    once their window has closed."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "failed")
    )


def closed_sessions(events: DataFrame, pause: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Calls, failures and largest value of each session of a user. A session ends with a pause; it comes
    out, and its state goes, once the watermark has passed that, so state is held for open sessions only."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.session_window("ts", pause).alias("s"), "user_id")
        .agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("event_type") == "error").alias("failed"), F.max("value").alias("largest"))
        .select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "calls", "failed", "largest")
    )
