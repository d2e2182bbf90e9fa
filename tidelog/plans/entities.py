"""Queries on entities and payloads, deliveries and keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions.timefn import trunc_ntz
from tidelog.operators import audit as A, entity as E
from tidelog.plans.base import LOG, log
from tidelog.plans.problems import identifier
from tidelog.plans.registry import Registry, table

R = Registry()
r6 = lambda c: F.round(c, 6).alias(c)


@R.query(
    "payload_inventory",
    LOG + "SELECT prn, count(DISTINCT message_hash) AS unique_messages, count(*) AS total_observations, min(datetime) AS first_seen, max(datetime) AS last_seen FROM log GROUP BY prn",
)
def payload_inventory(spark, sf):
    return E.payload_inventory(log(spark, sf))


@R.query("entity_payloads", LOG + "SELECT prn, message_hash, count(*) AS observations, min(datetime) AS first_seen, max(datetime) AS last_seen FROM log GROUP BY prn, message_hash")
def entity_payloads(spark, sf):
    return E.entity_payloads(log(spark, sf))


@R.query("exclusive_payloads", LOG + "SELECT message_hash, count(DISTINCT prn) AS prn_count, count(*) AS observation_count, list_sort(list(DISTINCT prn)) AS prns FROM log GROUP BY message_hash HAVING count(DISTINCT prn) <= 3")
def exclusive_payloads(spark, sf):
    return E.exclusive_payloads(log(spark, sf))


@R.query("conflicting_times", "SELECT datetime, prn, count(DISTINCT lower(message_hash)) AS messages FROM special_messages GROUP BY datetime, prn HAVING count(DISTINCT lower(message_hash)) > 1")
def conflicting_times(spark, sf):
    return E.conflicting_times(log(spark, sf))


@R.query(
    "payload_rarity",
    LOG + "SELECT message_hash, min(ascii_message) AS ascii_message, count(*) AS observation_count, count(DISTINCT prn) AS prn_count, count(DISTINCT CAST(datetime AS DATE)) AS day_count, min(datetime) AS first_seen, max(datetime) AS last_seen, "
    "round(cbrt(count(*)::DOUBLE * count(DISTINCT prn) * count(DISTINCT CAST(datetime AS DATE))), 6) AS rarity_score FROM log GROUP BY message_hash",
)
def payload_rarity(spark, sf):
    return E.payload_rarity(log(spark, sf, "ascii_message")).withColumn("rarity_score", F.round("rarity_score", 6))


@R.query(
    "rarity_by_entity",
    LOG + ", t AS (SELECT message_hash, count(*) AS n FROM log GROUP BY 1), p AS (SELECT DISTINCT prn, message_hash FROM log) "
    "SELECT prn, count(*) AS total_unique_messages, count(*) FILTER (n < 100) AS rare_messages, count(*) FILTER (n >= 100) AS common_messages, round(count(*) FILTER (n < 100) / count(*), 6) AS rare_ratio FROM p JOIN t USING (message_hash) GROUP BY prn",
)
def rarity_by_entity(spark, sf):
    return E.rarity_by_entity(log(spark, sf)).withColumn("rare_ratio", F.round("rare_ratio", 6))


@R.query(
    "entity_overlap",
    LOG + ", p AS (SELECT DISTINCT prn, message_hash FROM log), s AS (SELECT prn, count(*) AS n FROM p GROUP BY prn), "
    "c AS (SELECT a.prn AS prn1, b.prn AS prn2, count(*) AS common FROM p a JOIN p b ON a.message_hash = b.message_hash AND a.prn < b.prn GROUP BY 1, 2) "
    "SELECT x.prn AS prn1, y.prn AS prn2, coalesce(common, 0) AS common, x.n - coalesce(common, 0) AS only_first, y.n - coalesce(common, 0) AS only_second, x.n + y.n - coalesce(common, 0) AS either, "
    "round(coalesce(common, 0) / (x.n + y.n - coalesce(common, 0)), 6) AS jaccard FROM s x JOIN s y ON x.prn < y.prn LEFT JOIN c ON c.prn1 = x.prn AND c.prn2 = y.prn",
)
def entity_overlap(spark, sf):
    return E.entity_overlap(log(spark, sf)).withColumn("jaccard", F.round("jaccard", 6))


@R.query(
    "identical_deliveries",
    "WITH s AS (SELECT datetime, prn, lower(message_hash) AS message_hash, source_file, count(*) AS n, min(obs_id) AS f FROM special_messages GROUP BY ALL) "
    "SELECT datetime, prn, message_hash, CAST(sum(n) AS BIGINT) AS occurrence_count, count(*) AS distinct_sources, list(source_file ORDER BY f) AS source_files FROM s GROUP BY 1, 2, 3 HAVING sum(n) > 1",
)
def identical_deliveries(spark, sf):
    return A.identical_deliveries(table(spark, sf, "special_messages"), {"datetime": "datetime", "prn": "prn", "message_hash": F.lower("message_hash")}, "obs_id", "source_file")


@R.query(
    "deliveries_by_source",
    "SELECT datetime, prn, lower(message_hash) AS message_hash, source_file, count(*) AS deliveries, min(obs_id) AS first_id FROM special_messages GROUP BY 1, 2, 3, 4",
)
def deliveries_by_source(spark, sf):
    return A.deliveries_by_source(table(spark, sf, "special_messages"), {"datetime": "datetime", "prn": "prn", "message_hash": F.lower("message_hash")}, "obs_id", "source_file")


@R.query(
    "conflicting_deliveries",
    LOG + ", k AS (SELECT *, first_value(message_hash) OVER w AS existing_hash, first_value(source_file) OVER w AS existing_source, row_number() OVER w AS k FROM log WINDOW w AS (PARTITION BY datetime, prn ORDER BY obs_id)) "
    "SELECT datetime, prn, existing_hash, existing_source, message_hash AS new_hash, source_file AS new_source FROM k WHERE k > 1",
)
def conflicting_deliveries(spark, sf):
    return A.conflicting_deliveries(log(spark, sf, "obs_id", "source_file"))


@R.query(
    "delivery_totals",
    "WITH g AS (SELECT count(*) AS n FROM special_messages GROUP BY datetime, prn, lower(message_hash)) "
    "SELECT CAST(sum(n) AS BIGINT) AS deliveries, count(*) AS messages, count(*) FILTER (n > 1) AS repeated, CAST(sum(n - 1) AS BIGINT) AS redundant FROM g",
)
def delivery_totals(spark, sf):
    return A.delivery_totals(table(spark, sf, "special_messages"), identifier())


@R.query(
    "loader_list_by_entity",
    "WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY datetime, prn, lower(message_hash) ORDER BY dup_id) AS r FROM identical_duplicates) WHERE r = 1) "
    "SELECT prn, count(*) AS entries, CAST(sum(occurrence_count) AS BIGINT) AS occurrences, CAST(sum(len(source_files)) AS BIGINT) AS listed_files FROM d GROUP BY prn",
)
def loader_list_by_entity(spark, sf):
    from tidelog.operators.delivery import exactly_once

    d = exactly_once(table(spark, sf, "identical_duplicates"), identifier(), "dup_id")
    return d.groupBy("prn").agg(F.count(F.lit(1)).alias("entries"), F.sum("occurrence_count").alias("occurrences"), F.sum(F.size("source_files")).alias("listed_files"))


@R.query(
    "loader_list_busiest_days",
    "SELECT CAST(datetime AS DATE) AS day, count(*) AS entries FROM identical_duplicates GROUP BY 1 ORDER BY entries DESC, day LIMIT 20",
)
def loader_list_busiest_days(spark, sf):
    return table(spark, sf, "identical_duplicates").groupBy(F.to_date("datetime").alias("day")).agg(F.count(F.lit(1)).alias("entries")).orderBy(F.desc("entries"), "day").limit(20)


_PAIRS = """, m AS (SELECT datetime, prn, message_hash, source_file, obs_id, first_value(message_hash) OVER w AS fh, first_value(source_file) OVER w AS fs, row_number() OVER w AS k FROM log
             WINDOW w AS (PARTITION BY datetime, prn ORDER BY obs_id)), c AS (SELECT * FROM m WHERE k > 1)
"""


@R.query(
    "conflicts_by_entity",
    LOG + _PAIRS + "SELECT prn, count(*) AS conflicts, count(DISTINCT message_hash) AS new_messages, min(datetime) AS first_at, max(datetime) AS last_at FROM c GROUP BY prn",
)
def conflicts_by_entity(spark, sf):
    c = A.conflicting_deliveries(log(spark, sf, "obs_id", "source_file"))
    return c.groupBy("prn").agg(F.count(F.lit(1)).alias("conflicts"), F.count_distinct("new_hash").alias("new_messages"), F.min("datetime").alias("first_at"), F.max("datetime").alias("last_at"))


@R.query(
    "conflicts_by_source_pair",
    LOG + _PAIRS + "SELECT fs AS existing_source, source_file AS new_source, count(*) AS conflicts FROM c GROUP BY 1, 2 ORDER BY conflicts DESC, existing_source, new_source LIMIT 50",
)
def conflicts_by_source_pair(spark, sf):
    c = A.conflicting_deliveries(log(spark, sf, "obs_id", "source_file"))
    return c.groupBy("existing_source", "new_source").agg(F.count(F.lit(1)).alias("conflicts")).orderBy(F.desc("conflicts"), "existing_source", "new_source").limit(50)


@R.query(
    "conflicts_by_message_pair",
    LOG + _PAIRS + "SELECT fh AS existing_hash, message_hash AS new_hash, count(*) AS conflicts, list_sort(list(DISTINCT prn)) AS prns FROM c GROUP BY 1, 2 ORDER BY conflicts DESC, existing_hash, new_hash LIMIT 50",
)
def conflicts_by_message_pair(spark, sf):
    c = A.conflicting_deliveries(log(spark, sf, "obs_id", "source_file"))
    return c.groupBy("existing_hash", "new_hash").agg(F.count(F.lit(1)).alias("conflicts"), F.sort_array(F.collect_set("prn")).alias("prns")).orderBy(F.desc("conflicts"), "existing_hash", "new_hash").limit(50)


#: The same log by hours, each payload of an entity once an hour: an entity may send several in an hour.
_HOURS = """
    WITH log AS (SELECT date_trunc('hour', datetime)::TIMESTAMP AS datetime, prn, lower(message_hash) AS message_hash, source_file, obs_id FROM
        (SELECT *, row_number() OVER (PARTITION BY date_trunc('hour', datetime), prn, lower(message_hash) ORDER BY obs_id) AS r FROM special_messages) WHERE r = 1)
"""


def hours(spark, sf):
    m = table(spark, sf, "special_messages").select(trunc_ntz("hour", "datetime").alias("datetime"), "prn", F.lower("message_hash").alias("message_hash"), "obs_id", "source_file")
    return m.groupBy("datetime", "prn", "message_hash").agg(F.min(F.struct("obs_id", "source_file")).alias("_m")).select("datetime", "prn", "message_hash", "_m.*")


@R.query("conflicting_hours", "SELECT date_trunc('hour', datetime)::TIMESTAMP AS datetime, prn, count(DISTINCT lower(message_hash)) AS messages FROM special_messages GROUP BY 1, 2 HAVING count(DISTINCT lower(message_hash)) > 1")
def conflicting_hours(spark, sf):
    return E.conflicting_times(hours(spark, sf))


@R.query(
    "conflicts_in_hours",
    _HOURS + ", k AS (SELECT *, first_value(message_hash) OVER w AS existing_hash, first_value(source_file) OVER w AS existing_source, row_number() OVER w AS k FROM log WINDOW w AS (PARTITION BY datetime, prn ORDER BY obs_id)) "
    "SELECT datetime, prn, existing_hash, existing_source, message_hash AS new_hash, source_file AS new_source FROM k WHERE k > 1",
)
def conflicts_in_hours(spark, sf):
    """Each payload that arrives in an hour in which its entity already has another, paired with the first to arrive."""
    return A.conflicting_deliveries(hours(spark, sf))


@R.query(
    "hour_conflicts_by_entity",
    _HOURS + _PAIRS + "SELECT prn, count(*) AS conflicts, count(DISTINCT message_hash) AS new_messages, min(datetime) AS first_at, max(datetime) AS last_at FROM c GROUP BY prn",
)
def hour_conflicts_by_entity(spark, sf):
    c = A.conflicting_deliveries(hours(spark, sf))
    return c.groupBy("prn").agg(F.count(F.lit(1)).alias("conflicts"), F.count_distinct("new_hash").alias("new_messages"), F.min("datetime").alias("first_at"), F.max("datetime").alias("last_at"))


@R.query(
    "hour_conflicts_by_source_pair",
    _HOURS + _PAIRS + "SELECT fs AS existing_source, source_file AS new_source, count(*) AS conflicts FROM c GROUP BY 1, 2 ORDER BY conflicts DESC, existing_source, new_source LIMIT 50",
)
def hour_conflicts_by_source_pair(spark, sf):
    c = A.conflicting_deliveries(hours(spark, sf))
    return c.groupBy("existing_source", "new_source").agg(F.count(F.lit(1)).alias("conflicts")).orderBy(F.desc("conflicts"), "existing_source", "new_source").limit(50)


@R.query(
    "hour_conflicts_by_message_pair",
    _HOURS + _PAIRS + "SELECT fh AS existing_hash, message_hash AS new_hash, count(*) AS conflicts, list_sort(list(DISTINCT prn)) AS prns FROM c GROUP BY 1, 2 ORDER BY conflicts DESC, existing_hash, new_hash LIMIT 50",
)
def hour_conflicts_by_message_pair(spark, sf):
    c = A.conflicting_deliveries(hours(spark, sf))
    return c.groupBy("existing_hash", "new_hash").agg(F.count(F.lit(1)).alias("conflicts"), F.sort_array(F.collect_set("prn")).alias("prns")).orderBy(F.desc("conflicts"), "existing_hash", "new_hash").limit(50)


@R.query(
    "advisories_once",
    "SELECT nanu_id, msg_datetime, prn, nanu_type, category, event_start, event_stop, source_file FROM (SELECT *, row_number() OVER (PARTITION BY nanu_id ORDER BY source_file, msg_datetime NULLS FIRST, prn NULLS FIRST, nanu_type NULLS FIRST, category NULLS FIRST, event_start NULLS FIRST, event_stop NULLS FIRST) AS r FROM nanu_records) WHERE r = 1",
)
def advisories_once(spark, sf):
    return A.earliest_edition(table(spark, sf, "nanu_records"))


@R.query(
    "metrics_upserted",
    "WITH w AS (SELECT DISTINCT ON (CAST(period_start AS DATE), granularity, prn) CAST(period_start AS DATE) AS day, granularity, prn, max(observation_count) OVER (PARTITION BY CAST(period_start AS DATE), granularity, prn) AS n FROM behavioral_metrics) "
    "SELECT day, granularity, prn, CASE WHEN granularity = 'weekly' THEN n * 2 ELSE n END AS n FROM w",
)
def metrics_upserted(spark, sf):
    """Weekly rows replaced by key with corrected ones, the others kept."""
    m = table(spark, sf, "behavioral_metrics").groupBy(F.to_date("period_start").alias("day"), "granularity", "prn").agg(F.max("observation_count").alias("n"))
    return A.upsert(m, m.where("granularity = 'weekly'").withColumn("n", F.col("n") * 2), ["day", "granularity", "prn"])


@R.query(
    "advisories_inserted",
    "WITH f AS (SELECT nanu_id, source_file, 'first' AS edition FROM (SELECT nanu_id, min(source_file) AS source_file FROM nanu_records WHERE category <> 'forecast' GROUP BY 1)), "
    "l AS (SELECT nanu_id, max(source_file) AS source_file, 'last' AS edition FROM nanu_records GROUP BY 1) SELECT * FROM f UNION ALL SELECT * FROM l WHERE nanu_id NOT IN (SELECT nanu_id FROM f)",
)
def advisories_inserted(spark, sf):
    """First editions of what is no forecast, then the last editions of all whose key isn't there yet: known keys keep their row."""
    n = table(spark, sf, "nanu_records").select("nanu_id", "source_file", "category")
    known = n.where("category <> 'forecast'").groupBy("nanu_id").agg(F.min("source_file").alias("source_file"), F.lit("first").alias("edition"))
    return A.insert_new(known, n.groupBy("nanu_id").agg(F.max("source_file").alias("source_file"), F.lit("last").alias("edition")), ["nanu_id"])


@R.query(
    "corpus_totals",
    LOG + "SELECT count(*) AS observations, count(DISTINCT message_hash) AS messages, count(DISTINCT prn) AS prns, min(datetime) AS first_at, max(datetime) AS last_at, CAST(date_diff('day', min(datetime), max(datetime)) + 1 AS BIGINT) AS span_days FROM log",
)
def corpus_totals(spark, sf):
    a = log(spark, sf).agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("message_hash").alias("messages"), F.count_distinct("prn").alias("prns"), F.min("datetime").alias("first_at"), F.max("datetime").alias("last_at"))
    return a.withColumn("span_days", (F.date_diff("last_at", "first_at") + 1).cast("long"))


@R.query(
    "yearly_summary",
    LOG + "SELECT CAST(extract(year FROM datetime) AS INTEGER) AS y, CAST(extract(month FROM datetime) AS INTEGER) AS m, count(*) AS total, count(*) FILTER (entropy = 0) AS fillers, round(100.0 * count(*) FILTER (entropy = 0) / count(*), 6) AS filler_pct, "
    "count(DISTINCT CASE WHEN entropy = 0 THEN prn END) AS filler_prns, count(DISTINCT message_hash) AS messages FROM log GROUP BY 1, 2",
)
def yearly_summary(spark, sf):
    filler = F.col("entropy") == 0
    return log(spark, sf, "entropy").groupBy(F.year("datetime").alias("y"), F.month("datetime").alias("m")).agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(filler, 1)).alias("fillers"), F.round(100.0 * F.count(F.when(filler, 1)) / F.count(F.lit(1)), 6).alias("filler_pct"),
        F.count_distinct(F.when(filler, F.col("prn"))).alias("filler_prns"), F.count_distinct("message_hash").alias("messages"),
    )


@R.query(
    "text_by_entity",
    LOG + "SELECT prn, count(DISTINCT message_hash) AS texts, count(DISTINCT CAST(datetime AS DATE)) AS days, min(datetime) AS first_at FROM log WHERE starts_with(ascii_message, 'TEXT') GROUP BY prn",
)
def text_by_entity(spark, sf):
    t = log(spark, sf, "ascii_message").where(F.startswith("ascii_message", F.lit("TEXT")))
    return t.groupBy("prn").agg(F.count_distinct("message_hash").alias("texts"), F.count_distinct(F.to_date("datetime")).alias("days"), F.min("datetime").alias("first_at"))


@R.query("text_totals", LOG + "SELECT count(*) AS observations, count(DISTINCT (prn, CAST(datetime AS DATE))) AS prn_days, count(DISTINCT message_hash) AS messages, count(*) FILTER (contains(ascii_message, 'EW7')) AS with_part FROM log WHERE starts_with(ascii_message, 'TEXT') OR contains(ascii_message, 'EW7')")
def text_totals(spark, sf):
    t = log(spark, sf, "ascii_message").where(F.startswith("ascii_message", F.lit("TEXT")) | F.contains("ascii_message", F.lit("EW7")))
    return t.agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("prn", F.to_date("datetime")).alias("prn_days"), F.count_distinct("message_hash").alias("messages"), F.count(F.when(F.contains("ascii_message", F.lit("EW7")), 1)).alias("with_part"))


@R.query(
    "calendar_months",
    LOG + ", m AS (SELECT message_hash, prn, count(DISTINCT strftime(datetime, '%Y-%m')) AS months FROM log GROUP BY 1, 2) SELECT message_hash, max(months) AS months FROM m GROUP BY 1 HAVING max(months) > 1",
)
def calendar_months(spark, sf):
    m = log(spark, sf).groupBy("message_hash", "prn").agg(F.count_distinct(F.date_format("datetime", "yyyy-MM")).alias("months"))
    return m.groupBy("message_hash").agg(F.max("months").alias("months")).where("months > 1")


@R.query(
    "groups_per_day",
    LOG + ", d AS (SELECT CAST(datetime AS DATE) AS day, message_hash, count(DISTINCT prn) AS prns FROM log GROUP BY 1, 2), g AS (SELECT day, count(*) FILTER (prns >= 8) AS groups, CAST(sum(prns) AS BIGINT) AS pairs FROM d GROUP BY day) "
    "SELECT strftime(day, '%Y-%m') AS month, count(*) AS days, count(*) FILTER (groups = 1) AS one_group, count(*) FILTER (groups = 2) AS two_groups, count(*) FILTER (groups >= 3) AS more_groups, round(avg(pairs), 6) AS mean_pairs FROM g GROUP BY 1",
)
def groups_per_day(spark, sf):
    d = log(spark, sf).groupBy(F.to_date("datetime").alias("day"), "message_hash").agg(F.count_distinct("prn").alias("prns"))
    g = d.groupBy("day").agg(F.count(F.when(F.col("prns") >= 8, 1)).alias("groups"), F.sum("prns").alias("pairs"))
    n = lambda c: F.count(F.when(c, 1))
    return g.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("days"), n(F.col("groups") == 1).alias("one_group"), n(F.col("groups") == 2).alias("two_groups"), n(F.col("groups") >= 3).alias("more_groups"), F.round(F.avg("pairs"), 6).alias("mean_pairs")
    )


@R.query(
    "diversity_by_month",
    LOG + ", d AS (SELECT CAST(datetime AS DATE) AS day, count(DISTINCT message_hash) AS msgs, count(DISTINCT prn) AS prns FROM log GROUP BY 1) "
    "SELECT strftime(day, '%Y-%m') AS month, round(avg(msgs), 6) AS mean_messages, min(msgs) AS least, max(msgs) AS most, count(*) FILTER (msgs >= 50) AS rich_days FROM d WHERE prns >= 10 GROUP BY 1",
)
def diversity_by_month(spark, sf):
    d = log(spark, sf).groupBy(F.to_date("datetime").alias("day")).agg(F.count_distinct("message_hash").alias("msgs"), F.count_distinct("prn").alias("prns")).where("prns >= 10")
    return d.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.round(F.avg("msgs"), 6).alias("mean_messages"), F.min("msgs").alias("least"), F.max("msgs").alias("most"), F.count(F.when(F.col("msgs") >= 50, 1)).alias("rich_days"))


@R.query(
    "lifetimes_by_month",
    LOG + ", l AS (SELECT message_hash, prn, min(datetime) AS a, date_diff('hour', min(datetime), max(datetime)) AS hours FROM log WHERE entropy > 0 GROUP BY 1, 2) "
    "SELECT strftime(a, '%Y-%m') AS month, round(avg(hours), 6) AS mean_hours, round(median(hours), 6) AS median_hours, count(*) AS n FROM l WHERE hours > 0 GROUP BY 1",
)
def lifetimes_by_month(spark, sf):
    from tidelog.functions.timefn import hour_boundaries

    g = log(spark, sf, "entropy").where("entropy > 0").groupBy("message_hash", "prn").agg(F.min("datetime").alias("a"), F.max("datetime").alias("b")).withColumn("hours", hour_boundaries("a", "b")).where("hours > 0")
    return g.groupBy(F.date_format("a", "yyyy-MM").alias("month")).agg(F.round(F.avg("hours"), 6).alias("mean_hours"), F.round(F.median("hours"), 6).alias("median_hours"), F.count(F.lit(1)).alias("n"))


@R.query("first_days", LOG + ", f AS (SELECT prn, CAST(min(datetime) AS DATE) AS first_day FROM log GROUP BY prn) SELECT first_day, count(*) AS prns FROM f GROUP BY 1")
def first_days(spark, sf):
    return log(spark, sf).groupBy("prn").agg(F.to_date(F.min("datetime")).alias("first_day")).groupBy("first_day").agg(F.count(F.lit(1)).alias("prns"))


@R.query(
    "day_entity_messages",
    LOG + "SELECT CAST(datetime AS DATE) AS day, prn, message_hash, count(*) AS n, CASE WHEN starts_with(min(ascii_message), 'TEXT') THEN 'text' WHEN min(entropy) = 0 THEN 'filler' ELSE 'other' END AS phase FROM log GROUP BY 1, 2, 3",
)
def day_entity_messages(spark, sf):
    g = log(spark, sf, "ascii_message", "entropy").groupBy(F.to_date("datetime").alias("day"), "prn", "message_hash").agg(F.count(F.lit(1)).alias("n"), F.min("ascii_message").alias("m"), F.min("entropy").alias("e"))
    return g.select("day", "prn", "message_hash", "n", F.when(F.startswith("m", F.lit("TEXT")), "text").when(F.col("e") == 0, "filler").otherwise("other").alias("phase"))
