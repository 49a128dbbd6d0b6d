"""Running counts over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from archivolt.functions import security


def flagged(events: DataFrame, text: str = "props") -> DataFrame:
    """Events with flags: holds an injection phrase, names a secret key."""
    return events.withColumn("injection", ~security.is_safe(text)).withColumn("secret", security.is_secret_key(text))


def event_counts(events: DataFrame, text: str = "props") -> DataFrame:
    """Per event type: events, injection hits, secret hits (output mode update or complete)."""
    return flagged(events, text).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("injection").alias("injections"), F.count_if("secret").alias("secrets"))


def windowed_counts(events: DataFrame, text: str = "props", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """The same per time window; a window closes once the watermark has passed it."""
    timed = flagged(events, text).withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("injection").alias("injections"),
        F.count_if("secret").alias("secrets")).select(
        F.col("window.start").alias("start"), "event_type", "events", "injections", "secrets")
