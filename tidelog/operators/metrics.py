"""Daily and weekly metrics per entity and for the whole fleet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from tidelog.functions.text import is_sentinel
from tidelog.functions.timefn import trunc_ntz
from tidelog.operators.temporal import message_changes, observation_steps
from tidelog.session import stage

#: The entity number of the fleet's rows.
FLEET = 0


def _counts(log: DataFrame, unit: str) -> DataFrame:
    """Partial sums per (period, entity); one group of (payload, text, entropy) is one unique message."""
    groups = log.groupBy(trunc_ntz(unit, "datetime").alias("period_start"), "prn", "message_hash", "ascii_message", "entropy").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return groups.groupBy("period_start", "prn").agg(
        F.sum("n").alias("obs"),
        F.count(F.lit(1)).alias("uniq"),
        F.sum(F.coalesce("entropy", F.lit(0.0)) * n).alias("ent"),
        F.sum(F.when(is_sentinel(F.col("ascii_message")), n).otherwise(0)).alias("sent"),
        F.sum(F.when(F.startswith("ascii_message", F.lit("TEXT")), n).otherwise(0)).alias("txt"),
    )


def _rows(sums: DataFrame, granularity: str) -> DataFrame:
    weekly = granularity == "weekly"
    null = lambda kind: F.lit(None).cast(kind)
    return sums.select(
        "period_start", F.lit(granularity).alias("granularity"), "prn", F.col("obs").alias("observation_count"),
        (F.col("changes") if weekly else null("long")).alias("transition_count"), (F.col("uniq") if weekly else null("long")).alias("unique_message_count"),
        F.try_divide("ent", "obs").alias("mean_entropy"), F.try_divide("sent", "obs").alias("sentinel_fraction"), F.try_divide("txt", "obs").alias("text_fraction"),
        "active_prn_count", (F.col("held") if weekly else null("double")).alias("mean_duration_hours"),
    )


def behavioral_metrics(log: DataFrame) -> DataFrame:
    """Metrics of each (period, entity) by day and by week, and of the fleet as entity 0.

    Weeks in which an entity is silent between its first and last week come out with 0 observations. Weekly
    rows also have the number of changes of payload and the mean hours until the next change. The fleet's
    unique messages are the sum over entities. ``log`` has datetime, prn, message_hash, ascii_message, entropy.
    """
    changes = message_changes(observation_steps(log)).groupBy(trunc_ntz("week", "transition_time").alias("period_start"), "prn")
    held, known = F.col("held_hours"), F.col("held_hours") > 0
    parts = changes.agg(F.count(F.lit(1)).alias("changes"), F.sum(held).alias("s"), F.count(held).alias("n"), F.sum(F.when(known, held)).alias("s0"), F.count(F.when(known, 1)).alias("n0"))
    parts = stage(parts)  # a row per entity and week, as are the sums below; several branches read them
    mean = F.try_divide("s", "n")
    per_week = parts.select("period_start", "prn", "changes", F.when(mean > 0, mean).alias("held"))
    fleet_held = parts.groupBy("period_start").agg(F.try_divide(F.sum("s0"), F.sum("n0")).alias("held"))
    out = []
    for granularity, unit in (("daily", "day"), ("weekly", "week")):
        sums = stage(_counts(log, unit))
        own = sums.withColumn("active_prn_count", F.lit(None).cast("long"))
        fleet = sums.groupBy("period_start").agg(*(F.sum(c).alias(c) for c in ("obs", "uniq", "ent", "sent", "txt")), F.count(F.lit(1)).alias("active_prn_count")).withColumn("prn", F.lit(FLEET))
        if unit == "week":
            own = own.join(per_week, ["period_start", "prn"], "left")
            of_fleet = per_week.groupBy("period_start").agg(F.sum("changes").alias("changes"))
            fleet = fleet.join(of_fleet, "period_start", "left").join(fleet_held, "period_start", "left")
            out.append(_rows(silent_periods(sums).select("period_start", "prn", F.lit(0).cast("long").alias("obs"), *(F.lit(None).cast(k).alias(c) for c, k in (("uniq", "long"), ("ent", "double"), ("sent", "long"), ("txt", "long"), ("changes", "long"), ("held", "double"), ("active_prn_count", "long")))), granularity))
        out += [_rows(own, granularity), _rows(fleet, granularity)]
    return reduce(DataFrame.unionByName, out)


def silent_periods(active: DataFrame, entity: str = "prn", period: str = "period_start") -> DataFrame:
    """The periods, of those any entity has, in which an entity has no row though it has earlier and later ones.

    Periods are numbered in order, so an entity's range is a sequence of numbers and joins them by equality;
    distinct periods are few (weeks).
    """
    number = F.row_number().over(W.orderBy(period)).alias("_no")
    periods = active.select(F.col(period)).distinct().select(period, number)
    spans = active.join(periods, period).groupBy(entity).agg(F.min("_no").alias("_a"), F.max("_no").alias("_b")).where("_b > _a + 1")
    inside = spans.select(entity, F.explode(F.sequence(F.col("_a") + 1, F.col("_b") - 1)).alias("_no")).join(periods, "_no").select(period, entity)
    return inside.join(active.select(period, entity), [period, entity], "left_anti")


def relative_to_fleet(metrics: DataFrame) -> DataFrame:
    """``metrics`` with relative_count: an entity's observations over the fleet's mean per active entity; null if there is none."""
    fleet = metrics.where((F.col("prn") == FLEET) & (F.col("active_prn_count") > 0)).select("granularity", "period_start", (F.col("observation_count") / F.col("active_prn_count")).alias("_mean"))
    joined = metrics.join(fleet, ["granularity", "period_start"], "left")
    ratio = F.when(F.col("_mean") > 0, F.try_divide(F.col("observation_count").cast("double"), F.col("_mean")))
    return joined.withColumn("relative_count", F.when(F.col("prn") == FLEET, F.col("observation_count").cast("double")).otherwise(ratio)).drop("_mean")
