"""Steps and changes of payloads over time, their durations and calendar patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidelog.functions.stats import exact_quantiles
from tidelog.functions.timefn import day_of_week, days_between, hours_between, trunc_ntz
from tidelog.operators.neighbours import with_neighbour
from tidelog.session import stage


def matching(df: DataFrame, time: str = "datetime", start=None, end=None, year: int | None = None, **equal) -> DataFrame:
    """Rows with the given values and an inclusive time range; arguments that are None don't filter."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(time) <= F.lit(end))
    if year is not None:  # a range, so that it reaches the scan
        df = df.where((F.col(time) >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & (F.col(time) < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")))
    return df


def observation_steps(log: DataFrame, entity: str = "prn", time: str = "datetime", payload: str = "message_hash", text: str = "ascii_message") -> DataFrame:
    """Each observation and the entity's next: from and to payload, times and hours between; repeats of a payload are steps too."""
    rows = log.select(F.col(entity).alias("prn"), F.col(payload).alias("from_hash"), F.col(text).alias("from_message"), F.col(time).alias("transition_time"))
    steps = with_neighbour(rows, "prn", ["transition_time", "from_hash"], {"to_hash": "from_hash", "to_message": "from_message", "next_time": "transition_time"})
    return steps.withColumn("duration_hours", hours_between("transition_time", "next_time"))


def message_changes(steps: DataFrame) -> DataFrame:
    """Steps to another payload, with the hours until the entity's next such change."""
    changes = steps.where("to_hash is not null and from_hash <> to_hash").select("prn", "transition_time", "from_hash", "to_hash")
    held = with_neighbour(changes, "prn", ["transition_time", "from_hash"], {"next_change": "transition_time"})
    return held.withColumn("held_hours", hours_between("transition_time", "next_change"))


def payload_durations(log: DataFrame, entity: str = "prn", time: str = "datetime", payload: str = "message_hash", text: str = "ascii_message", min_hours: float = 0.0) -> DataFrame:
    """First and last time of each payload of each entity, and the days between."""
    d = log.groupBy(F.col(payload).alias("message_hash"), F.col(entity).alias("prn")).agg(
        F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count(F.lit(1)).alias("num_observations"), F.min(text).alias("ascii_message")
    )
    return d.where(hours_between("first_seen", "last_seen") >= min_hours).withColumn("duration_days", days_between("first_seen", "last_seen"))


def day_of_week_patterns(log: DataFrame, time: str = "datetime", payload: str = "message_hash") -> DataFrame:
    """Per weekday (0 is Sunday): observations, distinct payloads, the most frequent payload."""
    dow = day_of_week(time).alias("day_of_week")
    counts = log.groupBy(dow, F.col(payload).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("day_of_week").agg(F.sum("n").alias("observation_count"), F.count(F.lit(1)).alias("unique_messages"), F.max("n").alias("top"))
    return best.join(counts, "day_of_week").where("n = top").groupBy("day_of_week", "observation_count", "unique_messages").agg(F.min("h").alias("most_common_hash"))


def time_of_day_patterns(steps: DataFrame) -> DataFrame:
    """Per hour of the day: steps, mean hours to the next, distinct payloads left."""
    return steps.where("to_hash is not null").groupBy(F.hour("transition_time").alias("hour")).agg(
        F.count(F.lit(1)).alias("transition_count"), F.coalesce(F.avg("duration_hours"), F.lit(0.0)).alias("avg_duration_hours"), F.count_distinct("from_hash").alias("unique_messages")
    )


def half_hour_profile(steps: DataFrame) -> DataFrame:
    """Steps per entity and half hour of the day (0 to 47)."""
    half = (F.hour("transition_time") * 2 + F.floor(F.minute("transition_time") / F.lit(30))).cast("int")
    return steps.where("to_hash is not null").groupBy("prn", half.alias("half_hour_bin")).agg(F.count(F.lit(1)).alias("transition_count"))


def weekly_durations(steps: DataFrame) -> DataFrame:
    """Per entity and week (from Monday): mean and deviation of the hours between steps, and the number of steps."""
    return steps.where("to_hash is not null").groupBy("prn", trunc_ntz("week", "transition_time").alias("week")).agg(
        F.avg("duration_hours").alias("avg_duration"), F.stddev_samp("duration_hours").alias("std_duration"), F.count(F.lit(1)).alias("num_transitions")
    )


def moving_average_shifts(series: DataFrame, entity: str, time: str, value: str, width: int = 4, min_points: int = 10, change: float = 0.5, min_weeks: int = 8) -> DataFrame:
    """Points where the mean of ``width`` values from them on differs from the mean before by more than ``change``.

    ``series`` has one row per entity and time; entities with fewer than ``min_points`` rows have no shifts. Of
    shifts at most ``min_weeks`` weeks after the last one kept, none is kept. Series are short (one row per
    week), so the greedy choice folds an array per entity.
    """
    by = W.partitionBy(entity).orderBy(time)
    n, i = F.count(F.lit(1)).over(W.partitionBy(entity)), F.row_number().over(by)
    rows = series.where(F.col(value).isNotNull()).select(
        entity, time, n.alias("n"), i.alias("i"), F.avg(value).over(by.rowsBetween(-width, -1)).alias("before"), F.avg(value).over(by.rowsBetween(0, width - 1)).alias("after")
    )
    hits = rows.where((F.col("n") >= min_points) & F.col("i").between(width + 1, F.col("n") - width) & (F.abs(F.col("after") - F.col("before")) > change * F.abs(F.col("before"))))
    kept = F.aggregate(
        F.array_sort(F.collect_list(time)), F.expr("cast(array() as array<timestamp_ntz>)"),
        lambda acc, t: F.when((F.size(acc) == 0) | (days_between(F.try_element_at(acc, F.lit(-1)), t) > 7.0 * min_weeks), F.concat(acc, F.array(t))).otherwise(acc),
    )
    return hits.groupBy(entity).agg(kept.alias("_kept")).select(entity, F.explode("_kept").alias(time))


def duration_distribution(steps: DataFrame) -> DataFrame:
    """Mean, median, deviation, extremes and percentiles of the hours between steps, in one row."""
    h = "duration_hours"
    marks = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    known = stage(steps.where("to_hash is not null and duration_hours is not null").select(h))
    d = known.agg(F.avg(h).alias("mean_hours"), F.stddev_samp(h).alias("std_hours"), F.min(h).alias("min_hours"), F.max(h).alias("max_hours"), F.count(F.lit(1)).alias("num_transitions"))
    d = d.join(F.broadcast(exact_quantiles(known, h, marks)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return d.select(*(zero(F.col(c)).alias(c) for c in ("mean_hours", "std_hours", "min_hours", "max_hours")), *(zero(F.get("q", F.lit(i))).alias(f"p{int(m * 100)}_hours") for i, m in enumerate(marks)), "num_transitions")


def periodicity(steps: DataFrame, min_steps: int = 20, strength: float = 0.3) -> DataFrame:
    """Per entity: the two most frequent hours between steps (rounded half to even), their shares, and a class.

    Equally frequent values count by the lower one first. Entities with fewer than ``min_steps`` steps are irregular.
    """
    counts = steps.where("to_hash is not null and duration_hours is not null").groupBy("prn", F.rint("duration_hours").alias("hours")).agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy("prn").orderBy(F.desc("n"), "hours")
    ranked = counts.select("prn", "hours", "n", F.row_number().over(by).alias("r"), F.sum("n").over(W.partitionBy("prn")).alias("total"))
    at = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    d = ranked.groupBy("prn").agg(F.first("total").alias("total"), at(1, "hours").alias("h1"), at(1, "n").alias("n1"), at(2, "hours").alias("h2"), at(2, "n").alias("n2"))
    enough = F.col("total") >= min_steps
    s1 = F.col("n1") / F.col("total")
    kind = F.when(F.col("h1").between(10, 14), "orbital").when(F.col("h1").between(22, 26), "solar").when(F.col("h1").between(160, 176), "weekly").otherwise("irregular")
    return d.select(
        "prn", F.when(enough, F.col("h1")).otherwise(0.0).alias("dominant_hours"), F.when(enough, s1).otherwise(0.0).alias("dominant_strength"), F.when(enough, F.col("h2")).alias("secondary_hours"),
        F.when(enough, F.col("n2") / F.col("total")).alias("secondary_strength"), F.when(enough & (s1 > strength), kind).otherwise("irregular").alias("pattern"),
    )


def daily_correlation(steps: DataFrame, min_days: int = 30) -> DataFrame:
    """Correlation of the daily numbers of steps of each two entities over the days both have some.

    Pairs are formed per day among entities, of daily counts: days times entities squared, which doesn't grow
    with the observations. No variance gives 0.
    """
    daily = steps.where("to_hash is not null").groupBy("prn", F.to_date("transition_time").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    a, b = daily.select("day", F.col("prn").alias("prn1"), F.col("n").alias("x")), daily.select("day", F.col("prn").alias("prn2"), F.col("n").alias("y"))
    s = a.join(b, "day").where("prn1 < prn2").groupBy("prn1", "prn2").agg(
        F.count(F.lit(1)).alias("shared_days"), F.avg("x").alias("avg_a"), F.avg("y").alias("avg_b"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")
    )
    r = F.when((F.col("sx") > 0) & (F.col("sy") > 0), F.col("c") / F.nullif(F.col("sx") * F.col("sy"), F.lit(0.0))).otherwise(0.0)
    return s.where(F.col("shared_days") >= min_days).select("prn1", "prn2", "shared_days", "avg_a", "avg_b", r.alias("correlation"))
