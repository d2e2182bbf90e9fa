"""Queries on steps, changes, durations and calendar patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import temporal as T
from tidelog.operators.sentinels import entries_with_exit, fleet_flashes, segments, sentinel_events, sentinel_windows
from tidelog.functions.timefn import trunc_ntz
from tidelog.plans.base import CHANGES, LOG, STEPS, log, steps
from tidelog.plans.registry import Registry

R = Registry()
r6 = lambda c: F.round(c, 6).alias(c)
#: Means of entropies and times can lie exactly between two roundings; the nudge makes sums in any order round alike.
mean6 = lambda c: F.round(F.col(c) + 1e-10, 6).alias(c)


@R.query("observation_steps", STEPS + "SELECT prn, from_hash, to_hash, transition_time, round(duration_hours, 6) AS duration_hours FROM steps WHERE to_hash IS NOT NULL")
def observation_steps(spark, sf):
    return steps(spark, sf).where("to_hash is not null").select("prn", "from_hash", "to_hash", "transition_time", r6("duration_hours"))


@R.query("steps_in_range", STEPS + "SELECT prn, from_hash, to_hash, transition_time FROM steps WHERE to_hash IS NOT NULL AND transition_time BETWEEN '2007-06-20' AND '2007-07-05' AND prn = 17")
def steps_in_range(spark, sf):
    found = T.matching(steps(spark, sf), "transition_time", F.lit("2007-06-20").cast("timestamp_ntz"), F.lit("2007-07-05").cast("timestamp_ntz"), prn=17)
    return found.where("to_hash is not null").select("prn", "from_hash", "to_hash", "transition_time")


@R.query("message_changes", CHANGES + "SELECT prn, from_hash, to_hash, transition_time, round(held_hours, 6) AS held_hours FROM changes")
def message_changes(spark, sf):
    return T.message_changes(steps(spark, sf)).select("prn", "from_hash", "to_hash", "transition_time", r6("held_hours"))


@R.query(
    "payload_durations",
    LOG + "SELECT message_hash, prn, min(datetime) AS first_seen, max(datetime) AS last_seen, count(*) AS num_observations, min(ascii_message) AS ascii_message, "
    "round((epoch_us(max(datetime)) - epoch_us(min(datetime))) / 8.64e10, 6) AS duration_days FROM log GROUP BY message_hash, prn HAVING epoch_us(max(datetime)) - epoch_us(min(datetime)) >= 3600000000",
)
def payload_durations(spark, sf):
    return T.payload_durations(log(spark, sf, "ascii_message"), min_hours=1.0).withColumn("duration_days", F.round("duration_days", 6))


@R.query("messages_by_date_range", LOG + "SELECT datetime, prn, message_hash, ascii_message FROM log WHERE datetime BETWEEN '2007-07-01' AND '2007-07-03'")
def messages_by_date_range(spark, sf):
    return T.matching(log(spark, sf, "ascii_message"), "datetime", F.lit("2007-07-01").cast("timestamp_ntz"), F.lit("2007-07-03").cast("timestamp_ntz"))


@R.query(
    "day_of_week_year",
    LOG + "SELECT CAST(dayofweek(datetime) AS INTEGER) AS day_of_week, CAST(extract(year FROM datetime) AS INTEGER) AS y, count(*) AS observation_count, count(DISTINCT message_hash) AS unique_messages, "
    "round(avg(entropy) + 1e-10, 6) AS avg_entropy FROM log GROUP BY 1, 2",
)
def day_of_week_year(spark, sf):
    from tidelog.functions.timefn import day_of_week

    g = log(spark, sf, "entropy").groupBy(day_of_week("datetime").alias("day_of_week"), F.year("datetime").alias("y"))
    return g.agg(F.count(F.lit(1)).alias("observation_count"), F.count_distinct("message_hash").alias("unique_messages"), F.round(F.avg("entropy") + 1e-10, 6).alias("avg_entropy"))


@R.query(
    "day_of_week_patterns",
    LOG + ", c AS (SELECT CAST(dayofweek(datetime) AS INTEGER) AS day_of_week, message_hash, count(*) AS n FROM log GROUP BY 1, 2), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY day_of_week ORDER BY n DESC, message_hash) AS r FROM c) "
    "SELECT day_of_week, CAST(sum(n) AS BIGINT) AS observation_count, count(*) AS unique_messages, max(message_hash) FILTER (r = 1) AS most_common_hash FROM k GROUP BY 1",
)
def day_of_week_patterns(spark, sf):
    return T.day_of_week_patterns(log(spark, sf))


@R.query(
    "time_of_day_patterns",
    STEPS + "SELECT CAST(extract(hour FROM transition_time) AS INTEGER) AS hour, count(*) AS transition_count, round(avg(duration_hours) + 1e-10, 6) AS avg_duration_hours, count(DISTINCT from_hash) AS unique_messages "
    "FROM steps WHERE to_hash IS NOT NULL GROUP BY 1",
)
def time_of_day_patterns(spark, sf):
    return T.time_of_day_patterns(steps(spark, sf)).withColumn("avg_duration_hours", mean6("avg_duration_hours"))


@R.query(
    "half_hour_profile",
    STEPS + "SELECT prn, CAST(extract(hour FROM transition_time) * 2 + floor(extract(minute FROM transition_time) / 30) AS INTEGER) AS half_hour_bin, count(*) AS transition_count FROM steps WHERE to_hash IS NOT NULL GROUP BY 1, 2",
)
def half_hour_profile(spark, sf):
    return T.half_hour_profile(steps(spark, sf))


@R.query(
    "weekly_durations",
    STEPS + "SELECT prn, date_trunc('week', transition_time)::TIMESTAMP AS week, round(avg(duration_hours) + 1e-10, 6) AS avg_duration, round(stddev_samp(duration_hours) + 1e-10, 6) AS std_duration, count(*) AS num_transitions "
    "FROM steps WHERE to_hash IS NOT NULL GROUP BY 1, 2",
)
def weekly_durations(spark, sf):
    return T.weekly_durations(steps(spark, sf)).select("prn", "week", mean6("avg_duration"), mean6("std_duration"), "num_transitions")


@R.query(
    "rotation_shifts",
    STEPS.replace("WITH log AS", "WITH RECURSIVE log AS", 1) + ", d AS (SELECT prn, date_trunc('week', transition_time)::TIMESTAMP AS day, avg(duration_hours) AS v FROM steps WHERE to_hash IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2), "
    "n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY prn) AS n, avg(v) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS before, avg(v) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS after FROM d WINDOW w AS (PARTITION BY prn ORDER BY day)), "
    "h AS (SELECT prn, day FROM n WHERE n >= 10 AND i BETWEEN 5 AND n - 4 AND abs(after - before) > 0.5 * abs(before)), "
    "kept AS (SELECT prn, min(day) AS day FROM h GROUP BY prn UNION ALL SELECT k.prn, min(h.day) FROM kept k JOIN h ON h.prn = k.prn AND h.day > k.day + INTERVAL 56 DAY GROUP BY k.prn) SELECT prn, day AS week FROM kept",
)
def rotation_shifts(spark, sf):
    """Weeks in which an entity's mean hours between steps shift; weekly series of few weeks have none."""
    weekly = T.weekly_durations(steps(spark, sf)).where("num_transitions >= 2")
    return T.moving_average_shifts(weekly, "prn", "week", "avg_duration")


_SHIFTS = """,
    n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY prn) AS n, avg(v) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS before, avg(v) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS after FROM d WINDOW w AS (PARTITION BY prn ORDER BY day)),
    h AS (SELECT prn, day FROM n WHERE n >= 10 AND i BETWEEN 5 AND n - 4 AND abs(after - before) > 0.5 * abs(before)),
    kept AS (SELECT prn, min(day) AS day FROM h GROUP BY prn UNION ALL SELECT k.prn, min(h.day) FROM kept k JOIN h ON h.prn = k.prn AND h.day > k.day + INTERVAL 7 DAY GROUP BY k.prn)
    SELECT prn, day FROM kept
"""


@R.query(
    "daily_rotation_shifts",
    STEPS.replace("WITH log AS", "WITH RECURSIVE log AS", 1) + ", d AS (SELECT prn, date_trunc('day', transition_time)::TIMESTAMP AS day, avg(duration_hours) AS v FROM steps WHERE to_hash IS NOT NULL GROUP BY 1, 2)" + _SHIFTS,
)
def daily_rotation_shifts(spark, sf):
    """The same for days, of which a few weeks have enough: shifts more than a week after the last one kept."""
    daily = steps(spark, sf).where("to_hash is not null").groupBy("prn", trunc_ntz("day", "transition_time").alias("day")).agg(F.avg("duration_hours").alias("v"))
    return T.moving_average_shifts(daily, "prn", "day", "v", min_weeks=1)


@R.query(
    "duration_distribution",
    STEPS + "SELECT round(avg(duration_hours) + 1e-10, 6) AS mean_hours, round(stddev_samp(duration_hours) + 1e-10, 6) AS std_hours, round(min(duration_hours), 6) AS min_hours, round(max(duration_hours), 6) AS max_hours, "
    + ", ".join(f"round(quantile_cont(duration_hours, {q}), 6) AS p{int(q * 100)}_hours" for q in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))
    + ", count(*) AS num_transitions FROM steps WHERE to_hash IS NOT NULL",
)
def duration_distribution(spark, sf):
    d = T.duration_distribution(steps(spark, sf))
    return d.select(*(mean6(c) if c in ("mean_hours", "std_hours") else r6(c) for c in d.columns if c != "num_transitions"), "num_transitions")


_PERIODIC = """,
    c AS (SELECT prn, round_even(duration_hours, 0) AS h, count(*) AS n FROM steps WHERE to_hash IS NOT NULL GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY prn ORDER BY n DESC, h) AS r, sum(n) OVER (PARTITION BY prn) AS total FROM c),
    d AS (SELECT prn, max(total) AS total, max(h) FILTER (r = 1) AS h1, max(n) FILTER (r = 1) AS n1, max(h) FILTER (r = 2) AS h2, max(n) FILTER (r = 2) AS n2 FROM k GROUP BY prn)
    SELECT prn, CASE WHEN total >= 20 THEN h1 ELSE 0.0 END AS dominant_hours, round(CASE WHEN total >= 20 THEN n1 / total ELSE 0.0 END, 6) AS dominant_strength, CASE WHEN total >= 20 THEN h2 END AS secondary_hours,
           round(CASE WHEN total >= 20 THEN n2 / total END, 6) AS secondary_strength,
           CASE WHEN total >= 20 AND n1 / total > 0.3 THEN CASE WHEN h1 BETWEEN 10 AND 14 THEN 'orbital' WHEN h1 BETWEEN 22 AND 26 THEN 'solar' WHEN h1 BETWEEN 160 AND 176 THEN 'weekly' ELSE 'irregular' END ELSE 'irregular' END AS pattern
    FROM d
"""


@R.query("periodicity", STEPS + _PERIODIC)
def periodicity(spark, sf):
    return T.periodicity(steps(spark, sf)).select("prn", "dominant_hours", r6("dominant_strength"), "secondary_hours", r6("secondary_strength"), "pattern")


@R.query(
    "daily_correlation",
    STEPS + ", d AS (SELECT prn, CAST(transition_time AS DATE) AS day, count(*) AS n FROM steps WHERE to_hash IS NOT NULL GROUP BY 1, 2) "
    "SELECT a.prn AS prn1, b.prn AS prn2, count(*) AS shared_days, round(avg(a.n), 6) AS avg_a, round(avg(b.n), 6) AS avg_b, "
    "round(CASE WHEN stddev_pop(a.n) > 0 AND stddev_pop(b.n) > 0 THEN covar_pop(a.n, b.n) / (stddev_pop(a.n) * stddev_pop(b.n)) ELSE 0.0 END, 6) AS correlation "
    "FROM d a JOIN d b ON a.day = b.day AND a.prn < b.prn GROUP BY 1, 2 HAVING count(*) >= 10",
)
def daily_correlation(spark, sf):
    return T.daily_correlation(steps(spark, sf), min_days=10).select("prn1", "prn2", "shared_days", r6("avg_a"), r6("avg_b"), r6("correlation"))


_CLASS = "CASE WHEN regexp_full_match(ascii_message, '¬*') THEN 'all_aa' WHEN regexp_full_match(ascii_message, '�*') THEN 'all_nul' WHEN regexp_full_match(ascii_message, ' *') THEN 'all_space' ELSE 'unknown' END"
_EVENTS = LOG + f""",
    once AS (SELECT * FROM (SELECT prn, datetime, ascii_message, entropy, row_number() OVER (PARTITION BY prn, datetime ORDER BY message_hash) AS k FROM log) WHERE k = 1),
    seen AS (SELECT *, lag(entropy) OVER w AS p, lead(entropy) OVER w AS n FROM once WINDOW w AS (PARTITION BY prn ORDER BY datetime)),
    events AS (SELECT prn, {_CLASS} AS sentinel_type, 'enter' AS event_type, datetime AS event_date FROM seen WHERE entropy = 0 AND (p IS NULL OR p > 0)
               UNION ALL SELECT prn, {_CLASS}, 'exit', datetime FROM seen WHERE entropy = 0 AND n > 0)
"""


@R.query(
    "sentinel_windows",
    LOG + f"SELECT prn, {_CLASS} AS sentinel_type, min(datetime) AS first_seen, max(datetime) AS last_seen, count(*) AS obs_count, round((epoch_us(max(datetime)) - epoch_us(min(datetime))) / 8.64e10, 6) AS duration_days "
    "FROM log WHERE entropy = 0 GROUP BY prn, ascii_message",
)
def q_sentinel_windows(spark, sf):
    return sentinel_windows(log(spark, sf, "ascii_message", "entropy")).withColumn("duration_days", F.round("duration_days", 6))


def events(spark, sf):
    return sentinel_events(log(spark, sf, "ascii_message", "entropy"))


@R.query("sentinel_events", _EVENTS + "SELECT * FROM events")
def q_sentinel_events(spark, sf):
    return events(spark, sf)


@R.query(
    "fleet_flashes",
    _EVENTS + "SELECT CAST(event_date AS DATE) AS event_date, sentinel_type, count(*) AS prn_count, list_sort(list(DISTINCT prn)) AS prns FROM events WHERE event_type = 'enter' GROUP BY 1, 2 HAVING count(*) >= 5",
)
def q_fleet_flashes(spark, sf):
    return fleet_flashes(events(spark, sf), at_least=5)


@R.query(
    "sentinel_episodes",
    _EVENTS + "SELECT prn, sentinel_type, event_date AS enter_at, (SELECT min(x.event_date) FROM events x WHERE x.event_type = 'exit' AND x.prn = e.prn AND x.sentinel_type = e.sentinel_type AND x.event_date > e.event_date) AS exit_at "
    "FROM events e WHERE event_type = 'enter'",
)
def sentinel_episodes(spark, sf):
    return entries_with_exit(events(spark, sf)).select("prn", "sentinel_type", "enter_at", "exit_at")


@R.query(
    "entries_on_day",
    LOG + ", r AS (SELECT *, lag(ascii_message) OVER (PARTITION BY prn ORDER BY datetime, message_hash) AS before FROM log WHERE datetime BETWEEN '2007-07-01' AND '2007-07-10') "
    "SELECT DISTINCT prn, ascii_message FROM r WHERE CAST(datetime AS DATE) = '2007-07-05' AND (before IS NULL OR before <> ascii_message)",
)
def entries_on_day(spark, sf):
    """Texts that entities turn to on one day, looking back no further than the range."""
    from tidelog.operators.neighbours import with_neighbour

    some = T.matching(log(spark, sf, "ascii_message"), "datetime", F.lit("2007-07-01").cast("timestamp_ntz"), F.lit("2007-07-10").cast("timestamp_ntz"))
    seen = with_neighbour(some, "prn", ["datetime", "message_hash"], {"before": "ascii_message"}, forward=False)
    return seen.where((F.to_date("datetime") == F.lit("2007-07-05").cast("date")) & (F.col("before").isNull() | (F.col("before") != F.col("ascii_message")))).select("prn", "ascii_message").distinct()


@R.query(
    "payload_segments",
    LOG + ", a AS (SELECT prn, datetime, message_hash, CASE WHEN lag(message_hash) OVER w = message_hash THEN 0 ELSE 1 END AS c FROM log WINDOW w AS (PARTITION BY prn ORDER BY datetime, message_hash)), "
    "b AS (SELECT *, sum(c) OVER (PARTITION BY prn ORDER BY datetime, message_hash ROWS UNBOUNDED PRECEDING) AS i FROM a) "
    'SELECT prn, message_hash, min(datetime) AS "start", max(datetime) AS stop, count(*) AS observations FROM b GROUP BY prn, i, message_hash',
)
def payload_segments(spark, sf):
    return segments(log(spark, sf))
