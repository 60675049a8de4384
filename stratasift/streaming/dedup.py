"""Streaming over arriving files: first-seen content and latest state per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, time: str = "ts", content: str = "content", delay: str = "1 hour") -> DataFrame:
    """The first arrival of each content hash within a watermark: state is bounded by the delay, not by the stream."""
    hashed = stream.withColumn("hash", F.sha2(F.col(content).cast("binary"), 256)).withWatermark(time, delay)
    return hashed.dropDuplicatesWithinWatermark(["hash"])


def counts_by_window(stream: DataFrame, time: str, key: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Arrivals a key and time window, late ones dropped behind the watermark."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
