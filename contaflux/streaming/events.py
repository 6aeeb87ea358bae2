"""Streaming counters with watermarks: rate limits, bursts, sessions, ingest without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "10 minutes"


def timed(events: DataFrame) -> DataFrame:
    """A stream with a watermark on ts, which only a timestamp with a zone can carry; a batch as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE) if events.isStreaming else events


def rate_limited(events: DataFrame, key: str, window: str, limit: int) -> DataFrame:
    """Keys over the limit in a fixed window; works on batches and streams."""
    kind = events.schema["ts"].dataType
    return timed(events).groupBy(F.window("ts", window), key).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(F.col("window.start").cast(kind).alias("start"), key, "n")


def bursts(events: DataFrame, key: str, limit: int, length: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Keys over the limit in a sliding window."""
    kind = events.schema["ts"].dataType
    return timed(events).groupBy(F.window("ts", length, slide), key).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(F.col("window.start").cast(kind).alias("start"), key, "n")


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    kind = events.schema["ts"].dataType
    return timed(events).groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count("*").alias("n")).select(F.col("s.start").cast(kind).alias("start"), F.col("s.end").cast(kind).alias("stop"), key, "n")


def once(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once: within the watermark on a stream, at all on a batch."""
    return timed(events).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
