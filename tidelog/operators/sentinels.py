"""Filler payloads (entropy 0): windows, entries and exits, days on which many entities enter, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidelog.functions.text import sentinel_class
from tidelog.functions.timefn import days_between
from tidelog.operators.nearby import first_after
from tidelog.operators.neighbours import with_neighbours


def sentinel_windows(log: DataFrame) -> DataFrame:
    """First and last time, observations and days of each filler payload on each entity."""
    w = log.where("entropy = 0").groupBy("prn", "ascii_message").agg(F.min("datetime").alias("first_seen"), F.max("datetime").alias("last_seen"), F.count(F.lit(1)).alias("obs_count"))
    return w.select("prn", sentinel_class(F.col("ascii_message")).alias("sentinel_type"), "first_seen", "last_seen", "obs_count", days_between("first_seen", "last_seen").alias("duration_days"))


def sentinel_events(log: DataFrame) -> DataFrame:
    """(prn, sentinel_type, event_type, event_date): a filler payload after another payload (enter) or before one (exit).

    One observation per (entity, time) counts, that with the least payload hash. The first observation of an
    entity enters; the last doesn't exit. An unknown entropy next to it is neither, except that no known
    entropy before enters.
    """
    # by (entity, day) from the start: one shuffle serves both the choice of an observation and the neighbours
    days = log.withColumn("_day", F.to_date("datetime")).repartition("prn", "_day")
    once = days.groupBy("prn", "_day", "datetime").agg(F.min_by(F.struct("ascii_message", "entropy"), "message_hash").alias("_p")).select("prn", "_day", "datetime", "_p.*")
    seen = with_neighbours(once, "prn", ["datetime"], {"next_entropy": "entropy"}, {"prev_entropy": "entropy"}, F.col("_day"))
    kinds = F.array_compact(F.array(F.when(F.col("prev_entropy").isNull() | (F.col("prev_entropy") > 0), F.lit("enter")), F.when(F.col("next_entropy") > 0, F.lit("exit"))))
    return seen.where("entropy = 0").select("prn", sentinel_class(F.col("ascii_message")).alias("sentinel_type"), F.explode(kinds).alias("event_type"), F.col("datetime").alias("event_date"))


def fleet_flashes(events: DataFrame, at_least: int = 10) -> DataFrame:
    """Days on which one kind of filler is entered at least so often; prns lists the distinct entities."""
    return events.where("event_type = 'enter'").groupBy(F.to_date("event_date").alias("event_date"), "sentinel_type").agg(F.count(F.lit(1)).alias("prn_count"), F.sort_array(F.collect_set("prn")).alias("prns")).where(F.col("prn_count") >= at_least)


def entries_with_exit(events: DataFrame) -> DataFrame:
    """Each entry with the next exit of the same entity and kind, and the hours between; null while it lasts.

    An observation between two other payloads both enters and exits; such an exit isn't after the entry.
    """
    enter = events.where("event_type = 'enter'").select("prn", "sentinel_type", F.col("event_date").alias("enter_at"))
    leave = events.where("event_type = 'exit'").select("prn", "sentinel_type", F.col("event_date").alias("exit_at"))
    return first_after(enter, leave, ["prn", "sentinel_type"], "enter_at", "exit_at").withColumn("hours", days_between("enter_at", "exit_at") * 24)


def segments(log: DataFrame, entity: str = "prn", time: str = "datetime", label: str = "message_hash") -> DataFrame:
    """Maximal stretches of consecutive observations of an entity with the same label: start, stop, observations.

    Stretches are cut per entity and day. Only a day's first and last can go on in another day; those, two rows
    per day, are joined where labels agree, so no window holds all rows of an entity.
    """
    by = W.partitionBy(entity, "_d").orderBy(time, label)
    same = lambda w: F.lag(label).over(w).eqNullSafe(F.col(label)) & F.lag(F.lit(1)).over(w).isNotNull()
    d = log.select(entity, time, label, F.to_date(time).alias("_d")).withColumn("_i", F.when(same(by), 0).otherwise(1)).withColumn("_i", F.sum("_i").over(by))
    parts = d.groupBy(entity, "_d", "_i", label).agg(F.min(time).alias("start"), F.max(time).alias("stop"), F.count(F.lit(1)).alias("observations"))
    parts = parts.withColumn("_edge", (F.col("_i") == 1) | (F.col("_i") == F.max("_i").over(W.partitionBy(entity, "_d"))))
    over = W.partitionBy(entity).orderBy("start", "_d", "_i")
    edges = parts.where("_edge").withColumn("_j", F.when((F.col("_i") == 1) & same(over), 0).otherwise(1)).withColumn("_j", F.sum("_j").over(over.rowsBetween(W.unboundedPreceding, 0)))
    joined = edges.groupBy(entity, "_j", label).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("observations").alias("observations")).drop("_j")
    return joined.unionByName(parts.where("not _edge").select(*joined.columns))
