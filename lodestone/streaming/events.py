"""Streams of review events: copies dropped as they come, and running popularity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import review_key


def drop_copies(stream: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """The first copy of a user's review to arrive stays; state is kept for ``delay`` of event time."""
    keyed = stream.withColumn("review_key", review_key()).withWatermark(time, delay)
    return keyed.dropDuplicatesWithinWatermark(["UserId", "Score", "review_key"]).drop("review_key")


def popularity(stream: DataFrame, time: str = "ts", window: str = "1 day", delay: str = "1 hour", positive_threshold: float = 4.0) -> DataFrame:
    """Positive events per item and window; late events within ``delay`` still count."""
    good = stream.withWatermark(time, delay).filter(F.col("Score") >= positive_threshold)
    return good.groupBy(F.window(time, window).alias("window"), "ProductId").agg(F.count(F.lit(1)).alias("n"))
