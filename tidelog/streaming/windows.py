"""Watermarked deduplication and daily counts over streams; beyond what batch reports need."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stream_exactly_once(messages: DataFrame, identifier: list[str], time: str, within: str = "2 days") -> DataFrame:
    """One copy of each identifier among deliveries at most ``within`` apart; state older than that is dropped."""
    return messages.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, within).dropDuplicatesWithinWatermark(identifier)


def stream_daily_counts(messages: DataFrame, entity: str, time: str, payload: str, late: str = "1 day") -> DataFrame:
    """Observations and approximate distinct payloads per entity and day; a day closes when the watermark passes it."""
    m = messages.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    g = m.groupBy(F.window(time, "1 day").alias("w"), entity).agg(F.count(F.lit(1)).alias("observation_count"), F.approx_count_distinct(payload).alias("approx_messages"))
    return g.select(F.col("w.start").alias("day"), entity, "observation_count", "approx_messages")
