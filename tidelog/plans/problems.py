"""Queries of the general training-data problems: intervals (1), trailing totals (2), repeated deliveries (4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions.timefn import DAY_US
from tidelog.operators.delivery import exactly_once, redelivered
from tidelog.operators.intervals import continuous_periods
from tidelog.operators.rolling import trailing_totals
from tidelog.plans.registry import Registry, table

R = Registry()

_PERIODS = """
    WITH v AS (SELECT prn, epoch_us(first_seen) AS s, epoch_us(coalesce(last_seen, first_seen)) AS e FROM message_durations
               WHERE prn IS NOT NULL AND first_seen IS NOT NULL AND (last_seen IS NULL OR last_seen >= first_seen)),
         m AS (SELECT *, max(e) OVER (PARTITION BY prn ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM v),
         g AS (SELECT *, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END) OVER (PARTITION BY prn ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
         p AS (SELECT prn, island, min(s) AS start_us, max(e) AS stop_us FROM g GROUP BY prn, island),
         n AS (SELECT *, lead(start_us) OVER (PARTITION BY prn ORDER BY island) AS nxt FROM p),
         found AS (SELECT 'period' AS kind, prn, start_us, stop_us FROM n UNION ALL SELECT 'gap', prn, stop_us, nxt FROM n WHERE nxt IS NOT NULL)
"""


@R.query("p1_found", _PERIODS + f"SELECT * FROM found WHERE kind = 'period' OR stop_us - start_us <= {20 * DAY_US}")
def p1_found(spark, sf):
    found = continuous_periods(table(spark, sf, "message_durations"), "prn", "first_seen", "last_seen")
    return found.where((F.col("kind") == "period") | (F.col("stop_us") - F.col("start_us") <= 20 * DAY_US)).select("kind", "prn", "start_us", "stop_us")


@R.query(
    "p1_coverage",
    _PERIODS + "SELECT prn, count(*) FILTER (kind = 'period') AS periods, CAST(sum(stop_us - start_us) FILTER (kind = 'period') AS BIGINT) AS covered_us, "
    "CAST(coalesce(sum(stop_us - start_us) FILTER (kind = 'gap'), 0) AS BIGINT) AS silent_us FROM found GROUP BY prn",
)
def p1_coverage(spark, sf):
    found = continuous_periods(table(spark, sf, "message_durations"), "prn", "first_seen", "last_seen")
    length = F.col("stop_us") - F.col("start_us")
    is_period = F.col("kind") == "period"
    return found.groupBy("prn").agg(
        F.count(F.when(is_period, 1)).alias("periods"), F.sum(F.when(is_period, length)).alias("covered_us"), F.coalesce(F.sum(F.when(~is_period, length)), F.lit(0).cast("long")).alias("silent_us")
    )


_METRICS = ["observation_count", "transition_count"]
_TRAILING = """
    WITH daily AS (SELECT prn, CAST(period_start AS DATE) AS day, max(coalesce(observation_count, 0)) AS o, max(coalesce(transition_count, 0)) AS t
                   FROM behavioral_metrics WHERE granularity = 'daily' AND prn IS NOT NULL AND period_start IS NOT NULL GROUP BY 1, 2),
         nxt AS (SELECT *, lead(day) OVER (PARTITION BY prn ORDER BY day) AS n FROM daily),
         cal AS (SELECT prn, CAST(unnest(generate_series(CAST(day AS TIMESTAMP), CAST(CASE WHEN n - day <= 21 THEN n - 1 ELSE day END AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS on_day FROM nxt),
         tot AS (SELECT c.prn, c.on_day, sum(CASE WHEN d.day > c.on_day - 7 THEN d.o ELSE 0 END) AS o7, sum(d.o) AS o30,
                        sum(CASE WHEN d.day > c.on_day - 7 THEN d.t ELSE 0 END) AS t7, sum(d.t) AS t30
                 FROM cal c JOIN daily d ON d.prn = c.prn AND d.day <= c.on_day AND d.day > c.on_day - 30 GROUP BY 1, 2)
"""


def _trailing(spark, sf):
    return trailing_totals(table(spark, sf, "behavioral_metrics").where("granularity = 'daily'"), "prn", "period_start", _METRICS)


@R.query(
    "p2_found",
    _TRAILING + "SELECT prn, CAST(on_day AS VARCHAR) AS on_day, 'observation_count' AS metric FROM tot WHERE 60 * o7 < 7 * o30 "
    "UNION ALL SELECT prn, CAST(on_day AS VARCHAR), 'transition_count' FROM tot WHERE 60 * t7 < 7 * t30",
)
def p2_found(spark, sf):
    low = [F.when(60 * F.col(f"total_{m}_7") < 7 * F.col(f"total_{m}_30"), F.lit(m)) for m in _METRICS]
    return _trailing(spark, sf).select("prn", F.date_format("day", "yyyy-MM-dd").alias("on_day"), F.explode(F.array_compact(F.array(*low))).alias("metric"))


@R.query(
    "p2_trailing",
    _TRAILING + "SELECT prn, on_day AS day, CAST(o7 AS BIGINT) AS total_observation_count_7, CAST(o30 AS BIGINT) AS total_observation_count_30, CAST(t7 AS BIGINT) AS total_transition_count_7, "
    "CAST(t30 AS BIGINT) AS total_transition_count_30, o7 / 7.0::DOUBLE AS mean_observation_count_7, o30 / 30.0::DOUBLE AS mean_observation_count_30, "
    "t7 / 7.0::DOUBLE AS mean_transition_count_7, t30 / 30.0::DOUBLE AS mean_transition_count_30 FROM tot",
)
def p2_trailing(spark, sf):
    return _trailing(spark, sf)


def identifier() -> dict:
    """What makes two deliveries the same message; the hash counts in any letter case.

    64 hex digits are grouped by their 32 bytes, which halves the shuffle; any other string by its own bytes.
    """
    h = F.col("message_hash")
    return {"datetime": "datetime", "prn": "prn", "message_hash": F.when(h.rlike("^[0-9a-fA-F]{64}$"), F.unhex(h)).otherwise(F.encode(F.concat(F.lit("text:"), F.lower(h)), "utf-8"))}


_DROPS = """
    SELECT 'special_messages' AS tab, obs_id AS row_id FROM (SELECT obs_id, row_number() OVER (PARTITION BY datetime, prn, lower(message_hash) ORDER BY obs_id) AS r FROM special_messages) WHERE r > 1
    UNION ALL
    SELECT 'identical_duplicates', dup_id FROM (SELECT dup_id, row_number() OVER (PARTITION BY datetime, prn, lower(message_hash) ORDER BY dup_id) AS r FROM identical_duplicates) WHERE r > 1
"""


@R.query("p4_found", _DROPS)
def p4_found(spark, sf):
    # ids are the order of arrival, so they stand for the delivery time
    drops = [redelivered(table(spark, sf, tab), identifier(), i, order=[i]).select(F.lit(tab).alias("tab"), F.col(i).alias("row_id")) for tab, i in (("special_messages", "obs_id"), ("identical_duplicates", "dup_id"))]
    return drops[0].unionByName(drops[1])


@R.query(
    "p4_exactly_once",
    "SELECT obs_id, datetime, prn, lower(message_hash) AS message_hash, source_file FROM (SELECT *, row_number() OVER (PARTITION BY datetime, prn, lower(message_hash) ORDER BY obs_id) AS r FROM special_messages) WHERE r = 1",
)
def p4_exactly_once(spark, sf):
    return exactly_once(table(spark, sf, "special_messages").select("obs_id", "datetime", "prn", "message_hash", "source_file"), identifier(), "obs_id", order=["obs_id"]).select("obs_id", "datetime", "prn", F.lower("message_hash").alias("message_hash"), "source_file")
