"""Queries on metrics, change points and advisories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions.stats import exact_quantiles
from tidelog.functions.timefn import DAY_US, days_between, trunc_ntz
from tidelog.operators import audit, changepoint as C, metrics as M, nearby as N
from tidelog.operators.sentinels import sentinel_events
from tidelog.plans.base import CHANGES, LOG, log, steps
from tidelog.plans.registry import Registry, table
from tidelog.plans.sequences import _EVENTS
from tidelog.session import stage

R = Registry()
r6 = lambda c: F.round(c, 6).alias(c)


def computed(spark, sf):
    return M.behavioral_metrics(log(spark, sf, "ascii_message", "entropy"))


def _sums(unit: str, name: str) -> str:
    return f"""{name} AS (SELECT p AS period_start, prn, CAST(sum(n) AS BIGINT) AS obs, count(*) AS uniq, sum(coalesce(entropy, 0) * n) AS ent, CAST(sum(CASE WHEN regexp_full_match(ascii_message, '( *|�*|¬*)') THEN n ELSE 0 END) AS BIGINT) AS sent,
        CAST(sum(CASE WHEN starts_with(ascii_message, 'TEXT') THEN n ELSE 0 END) AS BIGINT) AS txt
        FROM (SELECT date_trunc('{unit}', datetime)::TIMESTAMP AS p, prn, message_hash, ascii_message, entropy, count(*) AS n FROM log GROUP BY ALL) GROUP BY 1, 2)"""


_ALL = CHANGES + f""",
    {_sums('day', 'dd')}, {_sums('week', 'ww')},
    pw AS (SELECT date_trunc('week', transition_time)::TIMESTAMP AS period_start, prn, count(*) AS changes, CASE WHEN avg(held_hours) > 0 THEN avg(held_hours) END AS held FROM changes GROUP BY 1, 2),
    fh AS (SELECT date_trunc('week', transition_time)::TIMESTAMP AS period_start, avg(held_hours) AS held FROM changes WHERE held_hours > 0 GROUP BY 1),
    fc AS (SELECT period_start, CAST(sum(changes) AS BIGINT) AS changes FROM pw GROUP BY 1),
    sp AS (SELECT prn, min(period_start) AS a, max(period_start) AS b FROM ww GROUP BY prn),
    al AS (
        SELECT period_start, 'daily' AS granularity, prn, obs, NULL AS changes, NULL AS uniq, ent, sent, txt, NULL AS active, NULL AS held FROM dd
        UNION ALL SELECT period_start, 'daily', 0, sum(obs), NULL, NULL, sum(ent), sum(sent), sum(txt), count(*), NULL FROM dd GROUP BY 1
        UNION ALL SELECT period_start, 'weekly', prn, obs, changes, uniq, ent, sent, txt, NULL, held FROM ww LEFT JOIN pw USING (period_start, prn)
        UNION ALL SELECT period_start, 'weekly', 0, obs, changes, uniq, ent, sent, txt, active, held FROM (SELECT period_start, sum(obs) AS obs, sum(uniq) AS uniq, sum(ent) AS ent, sum(sent) AS sent, sum(txt) AS txt, count(*) AS active FROM ww GROUP BY 1) LEFT JOIN fc USING (period_start) LEFT JOIN fh USING (period_start)
        UNION ALL SELECT w.period_start, 'weekly', sp.prn, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM sp JOIN (SELECT DISTINCT period_start FROM ww) w ON w.period_start > sp.a AND w.period_start < sp.b
            WHERE NOT EXISTS (SELECT 1 FROM ww WHERE ww.prn = sp.prn AND ww.period_start = w.period_start))
"""
_METRICS = _ALL + """
    SELECT period_start, granularity, prn, CAST(obs AS BIGINT) AS observation_count, CAST(changes AS BIGINT) AS transition_count, CAST(uniq AS BIGINT) AS unique_message_count, round(ent / nullif(obs, 0) + 1e-10, 6) AS mean_entropy,
           round(sent / nullif(obs, 0), 6) AS sentinel_fraction, round(txt / nullif(obs, 0), 6) AS text_fraction, CAST(active AS BIGINT) AS active_prn_count, round(held + 1e-10, 6) AS mean_duration_hours FROM al
"""
_ROUNDED = ["sentinel_fraction", "text_fraction"]
_MEANS = ["mean_entropy", "mean_duration_hours"]


@R.query("behavioral_metrics", _METRICS)
def behavioral_metrics(spark, sf):
    m = computed(spark, sf)
    # entropies have six decimals and times are whole seconds, so means lie exactly between two; the nudge makes sums in any order round alike
    return m.select(*(F.round(F.col(c) + 1e-10, 6).alias(c) if c in _MEANS else r6(c) if c in _ROUNDED else F.col(c) for c in m.columns))


_GIVEN = "WITH g AS (SELECT CAST(period_start AS DATE)::TIMESTAMP AS period_start, granularity, prn, max(observation_count) AS observation_count, max(transition_count) AS transition_count, max(active_prn_count) AS active_prn_count FROM behavioral_metrics GROUP BY 1, 2, 3)"


def given(spark, sf):
    """The table of metrics with one row per key, as the wider archive has it."""
    m = table(spark, sf, "behavioral_metrics")
    rest = [c for c in m.columns if c not in ("period_start", "granularity", "prn")]
    return m.groupBy(trunc_ntz("day", "period_start").alias("period_start"), "granularity", "prn").agg(*(F.max(c).alias(c) for c in rest))


@R.query(
    "relative_to_fleet",
    _GIVEN + ", f AS (SELECT granularity, period_start, observation_count / active_prn_count AS m FROM g WHERE prn = 0 AND active_prn_count > 0) "
    "SELECT granularity, period_start, prn, round(CASE WHEN prn = 0 THEN observation_count WHEN m > 0 THEN observation_count / m END, 6) AS relative_count FROM g LEFT JOIN f USING (granularity, period_start)",
)
def relative_to_fleet(spark, sf):
    return M.relative_to_fleet(given(spark, sf)).select("granularity", "period_start", "prn", r6("relative_count"))


@R.query(
    "silent_weeks",
    LOG + ", w AS (SELECT DISTINCT date_trunc('week', datetime)::TIMESTAMP AS period_start, prn FROM log), s AS (SELECT prn, min(period_start) AS a, max(period_start) AS b FROM w GROUP BY prn) "
    "SELECT p.period_start, s.prn FROM s JOIN (SELECT DISTINCT period_start FROM w) p ON p.period_start > a AND p.period_start < b ANTI JOIN w ON w.prn = s.prn AND w.period_start = p.period_start",
)
def silent_weeks(spark, sf):
    return M.silent_periods(log(spark, sf).select(trunc_ntz("week", "datetime").alias("period_start"), "prn").distinct())


#: Change points in SQL from a table g of metrics: each series as a list, then the cumulative sums step by step.
_POINTS = """,
    fl AS (SELECT granularity, period_start, max(observation_count / active_prn_count) AS mean FROM g WHERE prn = 0 AND active_prn_count > 0 GROUP BY 1, 2),
    rel AS (SELECT g.*, CASE WHEN prn = 0 THEN observation_count WHEN mean > 0 THEN observation_count / mean END::DOUBLE AS relative_count FROM g LEFT JOIN fl USING (granularity, period_start)),
    lng AS (SELECT granularity, prn, period_start, 'sentinel_fraction' AS metric, sentinel_fraction::DOUBLE AS v FROM rel UNION ALL SELECT granularity, prn, period_start, 'text_fraction', text_fraction FROM rel
            UNION ALL SELECT granularity, prn, period_start, 'mean_duration_hours', mean_duration_hours FROM rel UNION ALL SELECT granularity, prn, period_start, 'observation_count', relative_count FROM rel WHERE granularity <> 'daily'
            UNION ALL SELECT granularity, prn, period_start, 'transition_count', transition_count FROM rel WHERE granularity <> 'daily' UNION ALL SELECT granularity, prn, period_start, 'unique_message_count', unique_message_count FROM rel WHERE granularity <> 'daily'),
    ser AS (SELECT granularity, prn, metric, list(v ORDER BY period_start) AS x, list(period_start ORDER BY period_start) AS at, count(*) AS m FROM lng WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1, 2, 3),
    st AS (SELECT *, x[1:CAST(greatest(1, round_even(m * 0.2, 0)) AS BIGINT)] AS ref FROM ser WHERE m >= 8),
    cus AS (
        SELECT granularity, prn, metric, CAST(0 AS BIGINT) AS k, list_avg(ref) AS mean, CASE WHEN list_stddev_samp(ref) > 0 THEN list_stddev_samp(ref) ELSE 1.0 END AS dev, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, CAST(0 AS BIGINT) AS ua, CAST(0 AS BIGINT) AS da, CAST(NULL AS BIGINT) AS onset FROM st
        UNION ALL
        SELECT granularity, prn, metric, k + 1, CASE WHEN renew THEN list_avg(part) ELSE mean END, CASE WHEN NOT renew THEN dev WHEN list_stddev_samp(part) > 0 THEN list_stddev_samp(part) ELSE 1.0 END,
               CASE WHEN o IS NULL THEN u ELSE 0.0 END, CASE WHEN o IS NULL THEN d ELSE 0.0 END, CASE WHEN o IS NULL THEN na ELSE k + 1 END, CASE WHEN o IS NULL THEN nd ELSE k + 1 END, o
        FROM (SELECT *, x[o + 2:stop] AS part, coalesce(stop - o - 1 >= 8, false) AS renew
              FROM (SELECT *, least(m, o + 1 + CAST(greatest(8, round_even((m - o - 1) * 0.2, 0)) AS BIGINT)) AS stop
                    FROM (SELECT *, CASE WHEN u > 5 THEN na WHEN d > 5 THEN nd END AS o
                          FROM (SELECT *, CASE WHEN u > 0 AND up = 0 THEN k ELSE ua END AS na, CASE WHEN d > 0 AND dn = 0 THEN k ELSE da END AS nd
                                FROM (SELECT c.*, s.x, s.m, greatest(0.0, c.up + (s.x[c.k + 1] - c.mean) / c.dev - 0.5) AS u, greatest(0.0, c.dn - (s.x[c.k + 1] - c.mean) / c.dev - 0.5) AS d
                                      FROM cus c JOIN st s USING (granularity, prn, metric) WHERE c.k < s.m)))))),
    fnd AS (SELECT c.granularity, c.prn, c.metric, s.at[c.onset + 1] AS detected_at, CASE WHEN s.x[c.onset + 1] >= list_avg(s.ref) THEN 'increase' ELSE 'decrease' END AS direction FROM cus c JOIN st s USING (granularity, prn, metric) WHERE c.onset IS NOT NULL),
    oth AS (SELECT DISTINCT granularity, metric, prn AS other, detected_at AS other_at FROM fnd WHERE prn <> 0),
    cnt AS (SELECT f.granularity, f.metric, f.prn, f.detected_at, count(DISTINCT other) AS n FROM (SELECT DISTINCT granularity, metric, prn, detected_at FROM fnd) f JOIN oth o ON o.granularity = f.granularity AND o.metric = f.metric AND other <> f.prn
            AND other_at BETWEEN f.detected_at - INTERVAL 3 DAY AND f.detected_at + INTERVAL 3 DAY GROUP BY ALL),
    points AS (SELECT detected_at, granularity, prn, metric, direction, 5.0::DOUBLE AS cusum_statistic, prn <> 0 AND coalesce(n, 0) + 1 >= 3 AS is_coordinated, coalesce(n, 0) + CASE WHEN prn <> 0 THEN 1 ELSE 0 END AS coordinated_prn_count
               FROM fnd LEFT JOIN cnt USING (granularity, metric, prn, detected_at))
"""
_SIX = "sentinel_fraction text_fraction observation_count transition_count unique_message_count mean_duration_hours".split()
_GIVEN_ALL = "WITH RECURSIVE g AS (SELECT CAST(period_start AS DATE)::TIMESTAMP AS period_start, granularity, prn, " + ", ".join(f"max({c}) AS {c}" for c in [*_SIX, "active_prn_count"]) + " FROM behavioral_metrics GROUP BY 1, 2, 3)"
_COMPUTED = _ALL.replace("WITH log AS", "WITH RECURSIVE log AS", 1) + """,
    g AS (SELECT period_start, granularity, prn, CAST(obs AS BIGINT) AS observation_count, CAST(changes AS BIGINT) AS transition_count, CAST(uniq AS BIGINT) AS unique_message_count, sent / nullif(obs, 0) AS sentinel_fraction,
                 txt / nullif(obs, 0) AS text_fraction, CAST(active AS BIGINT) AS active_prn_count, held AS mean_duration_hours FROM al)
"""
_POINT_COLUMNS = "detected_at, granularity, prn, metric, direction, cusum_statistic, is_coordinated, coordinated_prn_count"
_EFFECTS = _GIVEN_ALL + _POINTS + """,
    raw AS (""" + " UNION ALL ".join(f"SELECT granularity, prn, period_start, '{c}' AS metric, {c}::DOUBLE AS v FROM g WHERE {c} IS NOT NULL" for c in _SIX) + """),
    nr AS (SELECT p.granularity, p.prn, p.metric, p.detected_at, avg(v) FILTER (period_start < detected_at) AS m1, avg(v) FILTER (period_start >= detected_at) AS m2, var_samp(v) FILTER (period_start < detected_at) AS v1,
                  var_samp(v) FILTER (period_start >= detected_at) AS v2, count(*) FILTER (period_start < detected_at) AS n1, count(*) FILTER (period_start >= detected_at) AS n2
           FROM (SELECT DISTINCT granularity, prn, metric, detected_at FROM points) p JOIN raw r ON r.granularity = p.granularity AND r.prn = p.prn AND r.metric = p.metric AND period_start >= detected_at - INTERVAL 56 DAY AND period_start < detected_at + INTERVAL 56 DAY GROUP BY 1, 2, 3, 4),
    pl AS (SELECT *, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / nullif(n1 + n2 - 2, 0)) AS pooled FROM nr),
    eff AS (SELECT points.*, coalesce(CASE WHEN n1 >= 2 AND n2 >= 2 AND pooled >= 1e-12 THEN abs(m2 - m1) / pooled ELSE 0.0 END, 0.0) AS effect_size FROM points LEFT JOIN pl USING (granularity, prn, metric, detected_at))
"""


@R.query("change_points", _GIVEN_ALL + _POINTS + f"SELECT {_POINT_COLUMNS} FROM points")
def change_points(spark, sf):
    """Of the given table; three entities make a shift coordinated here, as its small editions have few."""
    return C.change_points(given(spark, sf), coordinated=3)


@R.query("change_points_of_log", _COMPUTED + _POINTS + f"SELECT {_POINT_COLUMNS} FROM points")
def change_points_of_log(spark, sf):
    """From the log itself: its metrics, then their change points."""
    return C.change_points(computed(spark, sf), coordinated=3)


@R.query(
    "change_point_counts",
    _GIVEN_ALL + _POINTS + "SELECT granularity, metric, direction, count(*) AS points, count(*) FILTER (is_coordinated) AS coordinated, count(DISTINCT prn) AS prns FROM points GROUP BY 1, 2, 3",
)
def change_point_counts(spark, sf):
    c = change_points(spark, sf)
    return c.groupBy("granularity", "metric", "direction").agg(F.count(F.lit(1)).alias("points"), F.sum(F.col("is_coordinated").cast("int")).alias("coordinated"), F.count_distinct("prn").alias("prns"))


def effects(spark, sf):
    return C.effect_sizes(stage(change_points(spark, sf)), given(spark, sf))


@R.query("effect_sizes", _EFFECTS + f"SELECT {_POINT_COLUMNS}, round(effect_size, 6) AS effect_size FROM eff")
def effect_sizes(spark, sf):
    return effects(spark, sf).withColumn("effect_size", F.round("effect_size", 6))


@R.query("largest_effects", _EFFECTS + f", q AS (SELECT min(e) AS cut FROM (SELECT effect_size AS e, cume_dist() OVER (ORDER BY effect_size) AS c FROM eff) WHERE c >= 0.9) SELECT {_POINT_COLUMNS}, round(effect_size, 6) AS effect_size FROM eff, q WHERE effect_size >= cut")
def largest_effects(spark, sf):
    return C.nearest_rank_threshold(stage(effects(spark, sf)), "effect_size", 0.9).withColumn("effect_size", F.round("effect_size", 6))


@R.query("effect_percentiles", _EFFECTS + "SELECT round(quantile_cont(effect_size, 0.5), 6) AS median, round(quantile_cont(effect_size, 0.75), 6) AS p75, round(quantile_cont(effect_size, 0.9), 6) AS p90 FROM eff")
def effect_percentiles(spark, sf):
    q = exact_quantiles(effects(spark, sf), "effect_size", [0.5, 0.75, 0.9])
    return q.select(*(F.round(F.get("q", F.lit(i)), 6).alias(n) for i, n in enumerate(("median", "p75", "p90"))))


@R.query(
    "points_by_entity",
    _GIVEN_ALL + _POINTS + "SELECT prn, count(*) AS points, count(*) FILTER (is_coordinated) AS coordinated, min(detected_at) AS first_at, max(detected_at) AS last_at FROM points GROUP BY prn",
)
def points_by_entity(spark, sf):
    return change_points(spark, sf).groupBy("prn").agg(F.count(F.lit(1)).alias("points"), F.count(F.when(F.col("is_coordinated"), 1)).alias("coordinated"), F.min("detected_at").alias("first_at"), F.max("detected_at").alias("last_at"))


@R.query(
    "shift_dates",
    _GIVEN_ALL + _POINTS + "SELECT detected_at, metric, direction, max(coordinated_prn_count) AS prns, min(granularity) AS granularity FROM points GROUP BY 1, 2, 3",
)
def shift_dates(spark, sf):
    """Shifts of one day, metric and direction as one, with the most entities that coordinated in it."""
    return change_points(spark, sf).groupBy("detected_at", "metric", "direction").agg(F.max("coordinated_prn_count").alias("prns"), F.min("granularity").alias("granularity"))


_ADV = "adv AS (SELECT nanu_id, prn AS nanu_prn, nanu_type, msg_datetime FROM (SELECT *, row_number() OVER (PARTITION BY nanu_id ORDER BY source_file, msg_datetime NULLS FIRST, prn NULLS FIRST, nanu_type NULLS FIRST) AS r FROM nanu_records) WHERE r = 1)"


def advisories(spark, sf):
    return audit.earliest_edition(table(spark, sf, "nanu_records")).select("nanu_id", F.col("prn").alias("nanu_prn"), "nanu_type", "msg_datetime")


def sentinel_matches(spark, sf):
    e = sentinel_events(log(spark, sf, "ascii_message", "entropy"))
    same = F.col("nanu_prn").isNull() | (F.col("nanu_prn") == F.col("prn"))
    return N.band_join(e, advisories(spark, sf), "event_date", "msg_datetime", 14 * DAY_US, 14 * DAY_US, condition=same)


_MATCHES = _EVENTS + f", {_ADV}, m AS (SELECT e.*, a.* FROM events e JOIN adv a ON abs(epoch_us(event_date) - epoch_us(msg_datetime)) <= 14 * 86400000000 AND (nanu_prn IS NULL OR nanu_prn = prn))"


@R.query("sentinel_advisories", _MATCHES + "SELECT prn, sentinel_type, event_type, event_date, nanu_id, nanu_type, nanu_prn, round((epoch_us(event_date) - epoch_us(msg_datetime)) / 8.64e10, 6) AS time_offset_days FROM m")
def sentinel_advisories(spark, sf):
    return sentinel_matches(spark, sf).select("prn", "sentinel_type", "event_type", "event_date", "nanu_id", "nanu_type", "nanu_prn", F.round(days_between("msg_datetime", "event_date"), 6).alias("time_offset_days"))


LIFE_TYPES = ["DECOM", "LAUNCH", "USABINIT", "UNUSUFN", "UNUSABLE"]
_LIFE = "('DECOM', 'LAUNCH', 'USABINIT', 'UNUSUFN', 'UNUSABLE')"


@R.query(
    "lifecycle_match_rate",
    _MATCHES + f"SELECT (SELECT count(*) FROM (SELECT DISTINCT prn, event_type, event_date FROM m WHERE nanu_type IN {_LIFE})) AS matched, (SELECT count(*) FROM (SELECT DISTINCT prn, event_type, event_date FROM events)) AS total",
)
def lifecycle_match_rate(spark, sf):
    """Filler events with an advisory of a change in the entity's life nearby."""
    keys = ["prn", "event_type", "event_date"]
    e = sentinel_events(log(spark, sf, "ascii_message", "entropy")).select(*keys).distinct()
    a = advisories(spark, sf).where(F.col("nanu_type").isin("DECOM", "LAUNCH", "USABINIT", "UNUSUFN", "UNUSABLE"))
    same = F.col("nanu_prn").isNull() | (F.col("nanu_prn") == F.col("prn"))
    hit = N.band_join(e, a, "event_date", "msg_datetime", 14 * DAY_US, 14 * DAY_US, condition=same).select(*keys).distinct().withColumn("hit", F.lit(1))
    return e.join(hit, keys, "left").agg(F.count("hit").alias("matched"), F.count(F.lit(1)).alias("total"))


@R.query("unmatched_events", _MATCHES + "SELECT prn, sentinel_type, event_type, event_date FROM events ANTI JOIN m USING (prn, sentinel_type, event_type, event_date)")
def unmatched_events(spark, sf):
    e = sentinel_events(log(spark, sf, "ascii_message", "entropy"))
    same = F.col("nanu_prn").isNull() | (F.col("nanu_prn") == F.col("prn"))
    return N.band_join(e, advisories(spark, sf), "event_date", "msg_datetime", 14 * DAY_US, 14 * DAY_US, condition=same, how="left_anti")


@R.query(
    "advisory_type_matches",
    _MATCHES + ", t AS (SELECT nanu_type, count(*) AS total FROM adv GROUP BY 1), c AS (SELECT nanu_type, count(DISTINCT nanu_id) AS matched FROM m GROUP BY 1) SELECT nanu_type, total, coalesce(matched, 0) AS matched, round(coalesce(matched, 0) / total, 6) AS share FROM t LEFT JOIN c USING (nanu_type)",
)
def advisory_type_matches(spark, sf):
    a = advisories(spark, sf)
    c = sentinel_matches(spark, sf).groupBy("nanu_type").agg(F.count_distinct("nanu_id").alias("matched"))
    t = a.groupBy("nanu_type").agg(F.count(F.lit(1)).alias("total")).join(c, "nanu_type", "left").withColumn("matched", F.coalesce("matched", F.lit(0).cast("long")))
    return t.withColumn("share", F.round(F.col("matched") / F.col("total"), 6))


_NEAR_POINTS = _GIVEN_ALL + _POINTS + f""", {_ADV},
    cpa AS (SELECT detected_at AS cp_detected_at, granularity AS cp_granularity, prn AS cp_prn, metric AS cp_metric, nanu_id, nanu_type, nanu_prn, (epoch_us(detected_at) - epoch_us(msg_datetime)) / 8.64e10 AS time_offset_days, coalesce(nanu_prn = prn, false) AS prn_match
            FROM points JOIN adv ON abs(epoch_us(detected_at) - epoch_us(msg_datetime)) <= CASE WHEN granularity = 'weekly' THEN 7 ELSE 3 END * 86400000000 AND (prn = 0 OR nanu_prn IS NULL OR nanu_prn = prn))
"""


@R.query("change_point_advisories", _NEAR_POINTS + "SELECT * REPLACE (round(time_offset_days, 6) AS time_offset_days) FROM cpa")
def change_point_advisories(spark, sf):
    """Change points and the advisories near them: 7 days for weekly, 3 for daily ones; the fleet's match any advisory."""
    points, a = change_points(spark, sf), advisories(spark, sf)
    same = (F.col("prn") == M.FLEET) | F.col("nanu_prn").isNull() | (F.col("nanu_prn") == F.col("prn"))
    parts = [N.band_join(points.where(F.col("granularity") == g), a, "detected_at", "msg_datetime", d * DAY_US, d * DAY_US, condition=same) for g, d in (("weekly", 7), ("daily", 3))]
    return parts[0].unionByName(parts[1]).select(
        F.col("detected_at").alias("cp_detected_at"), F.col("granularity").alias("cp_granularity"), F.col("prn").alias("cp_prn"), F.col("metric").alias("cp_metric"), "nanu_id", "nanu_type", "nanu_prn",
        F.round(days_between("msg_datetime", "detected_at"), 6).alias("time_offset_days"), F.coalesce(F.col("nanu_prn") == F.col("prn"), F.lit(False)).alias("prn_match"),
    )


@R.query("advisory_permutations")
def advisory_permutations(spark, sf):
    """The share of filler events and of strong change points with an advisory nearby, and its one-sided p-value by 1,000 shuffles of the advisories' times.

    Filler events: 14 days, advisories of a change in the entity's life. Change points from the third quartile
    of effect sizes on: any advisory, 7 days for weekly and 3 for daily ones; a key of both is matched as weekly.
    """
    repeats = 1000
    reps = N.shuffled_times(advisories(spark, sf).select("nanu_prn", F.col("nanu_type").isin(*LIFE_TYPES).alias("life"), "msg_datetime"), "msg_datetime", repeats)
    keys = ["prn", "event_type", "event_date"]
    e = stage(sentinel_events(log(spark, sf, "ascii_message", "entropy")).select(*keys).distinct())
    fillers = N.matched_by_rep(e, reps.where("life"), keys, "event_date", "msg_datetime", 14 * DAY_US, repeats, "prn", "nanu_prn")
    keys = ["detected_at", "prn", "metric"]
    strong = C.nearest_rank_threshold(stage(effects(spark, sf)), "effect_size", 0.75)
    c = stage(strong.groupBy(*keys).agg(F.max(F.col("granularity") == "weekly").alias("weekly")))
    parts = [N.matched_by_rep(c.where(k), reps, keys, "detected_at", "msg_datetime", d * DAY_US, repeats, "prn", "nanu_prn", M.FLEET) for k, d in (("weekly", 7), ("not weekly", 3))]
    points = parts[0].unionByName(parts[1]).groupBy("rep").agg(F.sum("matched").alias("matched"))
    tests = [N.permutation_test(m, x.count()).select(F.lit(name).alias("test"), "*") for name, m, x in (("filler_events", fillers, e), ("change_points", points, c))]
    return tests[0].unionByName(tests[1])


@R.query(
    "nearest_advisory",
    f"WITH {_ADV}, e AS (SELECT nanu_id AS event_id, min(event_start) AS event_start FROM nanu_records WHERE event_start IS NOT NULL GROUP BY 1), "
    "j AS (SELECT event_id, nanu_id, epoch_us(msg_datetime) - epoch_us(event_start) AS offset_us FROM e JOIN adv ON abs(epoch_us(msg_datetime) - epoch_us(event_start)) <= 3 * 86400000000), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(offset_us), offset_us, nanu_id) AS r FROM j) SELECT event_id, nanu_id, offset_us FROM k WHERE r = 1",
)
def nearest_advisory(spark, sf):
    """The advisory sent closest to each advised event's start."""
    e = table(spark, sf, "nanu_records").where("event_start is not null").groupBy(F.col("nanu_id").alias("event_id")).agg(F.min("event_start").alias("event_start"))
    return N.nearest(e, advisories(spark, sf).select("nanu_id", "msg_datetime"), "event_id", "event_start", "msg_datetime", 3 * DAY_US, tie=["nanu_id"]).select("event_id", "nanu_id", "offset_us")


@R.query("changes_near_advisories", CHANGES + f", {_ADV} SELECT nanu_id, nanu_prn, count(*) AS changes FROM changes c JOIN adv a ON c.prn = a.nanu_prn AND epoch_us(transition_time) BETWEEN epoch_us(msg_datetime) - 86400000000 AND epoch_us(msg_datetime) + 86400000000 GROUP BY 1, 2")
def changes_near_advisories(spark, sf):
    from tidelog.operators.temporal import message_changes

    c = message_changes(steps(spark, sf)).select(F.col("prn").alias("nanu_prn"), "transition_time")
    return N.band_join(c, advisories(spark, sf).where("nanu_prn is not null"), "transition_time", "msg_datetime", DAY_US, DAY_US, ["nanu_prn"]).groupBy("nanu_id", "nanu_prn").agg(F.count(F.lit(1)).alias("changes"))


@R.query(
    "change_point_match_rate",
    _NEAR_POINTS + "SELECT (SELECT count(*) FROM (SELECT DISTINCT cp_detected_at, cp_prn, cp_metric FROM cpa)) AS matched, (SELECT count(*) FROM (SELECT DISTINCT detected_at, prn, metric FROM points)) AS total",
)
def change_point_match_rate(spark, sf):
    """Change points (by time, entity and metric) with an advisory nearby, and all of them."""
    keys = ["detected_at", "prn", "metric"]
    hit = change_point_advisories(spark, sf).select(*(F.col(f"cp_{k}").alias(k) for k in keys)).distinct().withColumn("hit", F.lit(1))
    return change_points(spark, sf).select(*keys).distinct().join(hit, keys, "left").agg(F.count("hit").alias("matched"), F.count(F.lit(1)).alias("total"))


@R.query(
    "lonely_change_points",
    _GIVEN_ALL + _POINTS + f", {_ADV} SELECT detected_at, granularity, prn, metric FROM points p WHERE NOT EXISTS (SELECT 1 FROM adv WHERE nanu_prn = p.prn AND abs(epoch_us(detected_at) - epoch_us(msg_datetime)) <= 3 * 86400000000)",
)
def lonely_change_points(spark, sf):
    """Change points without an advisory to their own entity within 3 days."""
    points = change_points(spark, sf).select("detected_at", "granularity", F.col("prn").alias("nanu_prn"), "metric")
    alone = N.band_join(points, advisories(spark, sf).where("nanu_prn is not null"), "detected_at", "msg_datetime", 3 * DAY_US, 3 * DAY_US, ["nanu_prn"], how="left_anti")
    return alone.withColumnRenamed("nanu_prn", "prn")


@R.query(
    "lonely_events",
    _EVENTS + f", {_ADV} SELECT prn, sentinel_type, event_type, event_date FROM events e WHERE NOT EXISTS (SELECT 1 FROM adv WHERE nanu_prn = e.prn AND abs(epoch_us(event_date) - epoch_us(msg_datetime)) <= 86400000000)",
)
def lonely_events(spark, sf):
    """Filler events without an advisory to their own entity within a day."""
    e = sentinel_events(log(spark, sf, "ascii_message", "entropy")).withColumnRenamed("prn", "nanu_prn")
    alone = N.band_join(e, advisories(spark, sf).where("nanu_prn is not null"), "event_date", "msg_datetime", DAY_US, DAY_US, ["nanu_prn"], how="left_anti")
    return alone.withColumnRenamed("nanu_prn", "prn")


_MILESTONES = "ms AS (SELECT nanu_type AS milestone, date_trunc('week', msg_datetime)::TIMESTAMP AS week, min(msg_datetime) AS sent FROM adv GROUP BY 1, 2)"


@R.query(
    "milestone_matches",
    _GIVEN_ALL + _POINTS + f", {_ADV}, {_MILESTONES}, "
    "cp AS (SELECT DISTINCT detected_at FROM points WHERE is_coordinated), j AS (SELECT milestone, week, detected_at, epoch_us(detected_at) - epoch_us(sent) AS offset_us FROM ms JOIN cp ON abs(epoch_us(detected_at) - epoch_us(sent)) <= 10 * 86400000000), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY milestone, week ORDER BY abs(offset_us), offset_us) AS r FROM j) SELECT milestone, week, detected_at, offset_us FROM k WHERE r = 1",
)
def milestone_matches(spark, sf):
    """For the first advisory of each type in each week: the nearest day of a coordinated shift within 10 days."""
    points = change_points(spark, sf).where("is_coordinated").select("detected_at").distinct()
    return N.nearest(milestones(spark, sf), points, "id", "sent", "detected_at", 10 * DAY_US).select("milestone", "week", "detected_at", "offset_us")


def milestones(spark, sf):
    a = advisories(spark, sf).groupBy(F.col("nanu_type").alias("milestone"), trunc_ntz("week", "msg_datetime").alias("week")).agg(F.min("msg_datetime").alias("sent"))
    return a.withColumn("id", F.concat_ws(" ", F.coalesce("milestone", F.lit("")), F.col("week").cast("string")))


@R.query(
    "concordance",
    _GIVEN_ALL + _POINTS + f", {_ADV}, {_MILESTONES}, "
    "t AS (SELECT milestone, week, EXISTS (SELECT 1 FROM points WHERE is_coordinated AND abs(epoch_us(detected_at) - epoch_us(sent)) <= 10 * 86400000000) AS shift, "
    "EXISTS (SELECT 1 FROM points WHERE NOT is_coordinated AND abs(epoch_us(detected_at) - epoch_us(sent)) <= 3 * 86400000000) AS single FROM ms) "
    "SELECT milestone, count(*) AS weeks, count(*) FILTER (shift) AS with_shift, count(*) FILTER (single) AS with_single, count(*) FILTER (shift = single) AS agreeing FROM t GROUP BY milestone",
)
def concordance(spark, sf):
    """Per type of advisory: weeks near a coordinated shift (10 days), near another one (3 days), and those in which both tests agree."""
    points, ms = stage(change_points(spark, sf)), milestones(spark, sf)
    near = lambda p, d, name: N.band_join(ms, p.select("detected_at").distinct(), "sent", "detected_at", d * DAY_US, d * DAY_US).select("id").distinct().withColumn(name, F.lit(True))
    t = ms.join(near(points.where("is_coordinated"), 10, "shift"), "id", "left").join(near(points.where("not is_coordinated"), 3, "single"), "id", "left")
    a, b = F.coalesce("shift", F.lit(False)), F.coalesce("single", F.lit(False))
    return t.groupBy("milestone").agg(F.count(F.lit(1)).alias("weeks"), F.count("shift").alias("with_shift"), F.count("single").alias("with_single"), F.count(F.when(a == b, 1)).alias("agreeing"))


@R.query(
    "rotation_rate",
    "WITH w AS (SELECT CAST(period_start AS DATE) AS day, prn, max(unique_message_count) AS u, max(transition_count) AS t FROM behavioral_metrics WHERE granularity = 'weekly' AND prn <> 0 GROUP BY 1, 2) "
    "SELECT strftime(day, '%Y-%m') AS month, count(*) AS prn_weeks, round(7 / nullif(avg(u), 0), 6) AS days_per_message, round(avg(t / nullif(u, 0)), 6) AS changes_per_message FROM w WHERE u IS NOT NULL GROUP BY 1",
)
def rotation_rate(spark, sf):
    """Per month: the days that a payload lasts by the number of distinct ones a week, and changes per payload."""
    w = given(spark, sf).where("granularity = 'weekly' and prn <> 0 and unique_message_count is not null")
    u, t = F.col("unique_message_count"), F.col("transition_count")
    return w.groupBy(F.date_format("period_start", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("prn_weeks"), F.round(F.try_divide(F.lit(7.0), F.avg(u)), 6).alias("days_per_message"), F.round(F.avg(F.try_divide(t.cast("double"), u)), 6).alias("changes_per_message")
    )


@R.query(
    "weekly_spread",
    "WITH w AS (SELECT CAST(period_start AS DATE) AS day, prn, max(observation_count) AS n FROM behavioral_metrics WHERE granularity = 'weekly' AND prn <> 0 GROUP BY 1, 2) "
    "SELECT day, count(n) AS prns, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS deviation FROM w GROUP BY day",
)
def weekly_spread(spark, sf):
    w = given(spark, sf).where("granularity = 'weekly' and prn <> 0")
    return w.groupBy(F.to_date("period_start").alias("day")).agg(F.count("observation_count").alias("prns"), F.round(F.avg("observation_count"), 6).alias("mean"), F.round(F.stddev_samp("observation_count"), 6).alias("deviation"))


@R.query(
    "advisories_listed",
    "SELECT nanu_id, msg_datetime, prn, nanu_type FROM (SELECT DISTINCT nanu_id, msg_datetime, prn, nanu_type FROM nanu_records WHERE nanu_type = 'UNUSABLE') ORDER BY msg_datetime NULLS LAST, nanu_id, prn NULLS LAST LIMIT 100",
)
def advisories_listed(spark, sf):
    """The first hundred advisories of one type."""
    a = table(spark, sf, "nanu_records").where("nanu_type = 'UNUSABLE'").select("nanu_id", "msg_datetime", "prn", "nanu_type").distinct()
    return a.orderBy(F.col("msg_datetime").asc_nulls_last(), "nanu_id", F.col("prn").asc_nulls_last()).limit(100)
