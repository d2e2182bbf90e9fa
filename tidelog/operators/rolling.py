"""Totals and averages over trailing calendar periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F


def daily_totals(df: DataFrame, entity: str, time: str, metrics: Sequence[str], how: str = "max") -> DataFrame:
    """One row per entity and day: (entity, day, metrics). ``how`` is 'max' where rows of a day are copies, or 'sum'. Null counts are 0."""
    agg = {"max": F.max, "sum": F.sum}[how]
    rows = df.select(F.col(entity).alias("k"), F.to_date(F.col(time)).alias("day"), *(F.coalesce(F.col(m).cast("long"), F.lit(0).cast("long")).alias(f"m{i}") for i, m in enumerate(metrics)))
    return rows.where("k is not null and day is not null").groupBy("k", "day").agg(*(agg(f"m{i}").alias(f"m{i}") for i in range(len(metrics))))


def trailing_totals(
    df: DataFrame, entity: str, time: str, metrics: Sequence[str], periods: Sequence[int] = (7, 30), max_silence: int = 21, how: str = "max", bucket_days: int = 32
) -> DataFrame:
    """Totals and averages of each metric over the trailing ``periods`` in days, for each entity and calendar day.

    Returns (entity, day, total_<metric>_<days>, mean_<metric>_<days>). A day counts if the entity has a row
    on it, or lies between two neighbouring days with rows that are at most ``max_silence`` days apart; days
    without a row add 0. Rows of a day are copies of which one counts (``how='max'``) or are added up
    (``how='sum'``). Null counts are 0; rows without entity or time belong to no day and are left out. Other
    columns of any name are ignored.

    Daily totals are joined to the calendar on (entity, bucket of ``bucket_days`` days), with the trailing
    bounds as range condition; a calendar day looks into the buckets its longest period touches. Buckets
    split busy entities, and the sums combine before their shuffle.
    """
    far = max(periods)
    daily = daily_totals(df, entity, time, metrics, how)
    nxt = F.lead("day").over(W.partitionBy("k").orderBy("day"))
    calendar = (
        daily.select("k", "day", nxt.alias("nxt"))
        .select("k", "day", F.when(F.date_diff("nxt", "day") <= max_silence, F.date_sub("nxt", 1)).otherwise(F.col("day")).alias("upto"))
        .select("k", F.explode(F.sequence("day", "upto")).alias("on_day"))
    )
    bucket = lambda d: F.floor(F.unix_date(d) / F.lit(bucket_days))
    asked = calendar.select("k", "on_day", F.explode(F.sequence(bucket(F.date_sub("on_day", far - 1)), bucket(F.col("on_day")))).alias("bucket"))
    joined = asked.join(daily.withColumn("bucket", bucket(F.col("day"))), ["k", "bucket"]).where((F.col("day") <= F.col("on_day")) & (F.col("day") > F.date_sub("on_day", far)))
    totals = {
        (m, p): F.sum(F.when(F.col("day") > F.date_sub("on_day", p), F.col(f"m{i}")).otherwise(0)).alias(f"total_{m}_{p}") for i, m in enumerate(metrics) for p in periods
    }
    # a silent day whose trailing bounds hold no row has no join partner; it counts with 0
    summed = calendar.join(joined.groupBy("k", "on_day").agg(*totals.values()), ["k", "on_day"], "left") if max_silence > far else joined.groupBy("k", "on_day").agg(*totals.values())
    out = summed.select(
        F.col("k").alias(entity),
        F.col("on_day").alias("day"),
        *(F.coalesce(f"total_{m}_{p}", F.lit(0).cast("long")).alias(f"total_{m}_{p}") for m, p in totals),
        *((F.coalesce(f"total_{m}_{p}", F.lit(0).cast("long")) / F.lit(float(p))).alias(f"mean_{m}_{p}") for m, p in totals),
    )
    return out
