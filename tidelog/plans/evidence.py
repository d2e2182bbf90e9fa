"""Queries on distributions, tail probabilities, effects and printed numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import stats, text as X
from tidelog.functions.timefn import trunc_ntz
from tidelog.plans.base import LOG, log
from tidelog.plans.registry import Registry, table

R = Registry()
p6 = lambda c, name: F.round(c, 6).alias(name)


def sql_normal_sf(z: str) -> str:
    """SQL of the upper tail of the normal distribution by the same polynomial."""
    t = f"(1.0::DOUBLE / (1.0 + 0.2316419 * abs({z})))"
    poly = "0.0::DOUBLE"
    for c in reversed(stats.NORMAL):
        poly = f"{t} * ({c}::DOUBLE + {poly})"
    tail = f"(0.3989422804014327 * exp(-({z}) * ({z}) / 2.0) * {poly})"
    return f"(CASE WHEN {z} < -8 THEN 1.0 WHEN {z} > 8 THEN 0.0 WHEN {z} >= 0 THEN 1.0 - (1.0 - {tail}) ELSE 1.0 - {tail} END)"


def sql_poisson_sf(k: str, rate: str) -> str:
    return f"(CASE WHEN {k} < 0 THEN 1.0 WHEN {rate} = 0 THEN 0.0 ELSE 1.0 - least(1.0, list_sum(list_transform(range(0, CAST({k} AS BIGINT) + 1), lambda i: exp(i * ln({rate}) - {rate} - lgamma(i + 1))))) END)"


def sql_binomial_sf(k: str, n: str, p: str) -> str:
    var = f"({n} * {p} * (1.0 - {p}))"
    exact = f"least(1.0, list_sum(list_transform(range(CAST({k} AS BIGINT) + 1, CAST({n} AS BIGINT) + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1.0 - {p})))))"
    z = f"(({k} + 0.5 - {n} * {p}) / sqrt({var}))"
    return f"(CASE WHEN {k} < 0 THEN 1.0 WHEN {k} >= {n} THEN 0.0 WHEN {p} <= 0 THEN 0.0 WHEN {p} >= 1 THEN 1.0 WHEN {var} > 25 THEN {sql_normal_sf(z)} ELSE {exact} END)"


_DAILY = LOG + ", c AS (SELECT prn, CAST(datetime AS DATE) AS day, count(*) AS n FROM log GROUP BY 1, 2), r AS (SELECT prn, avg(n) AS rate FROM c GROUP BY prn)"


def daily_rates(spark, sf):
    c = log(spark, sf).groupBy("prn", F.to_date("datetime").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return c.join(c.groupBy("prn").agg(F.avg("n").alias("rate")), "prn")


@R.query(
    "busy_days",
    _DAILY + f" SELECT prn, day, n, round({sql_poisson_sf('(n - 1)', 'rate')}, 6) AS poisson_p, round(CASE WHEN n < 0 THEN 0 ELSE exp(n * ln(rate) - rate - lgamma(n + 1)) END, 6) AS poisson_pmf FROM c JOIN r USING (prn)",
)
def busy_days(spark, sf):
    """How probable as many observations of an entity on a day are by its own mean."""
    d = daily_rates(spark, sf)
    return d.select("prn", "day", "n", p6(stats.poisson_sf(F.col("n") - 1, F.col("rate")), "poisson_p"), p6(stats.poisson_pmf(F.col("n").cast("double"), F.col("rate")), "poisson_pmf"))


@R.query(
    "entity_share_tests",
    LOG + ", t AS (SELECT count(*) AS n, count(*) FILTER (starts_with(ascii_message, 'TEXT'))::DOUBLE / count(*) AS p FROM log), "
    "c AS (SELECT CAST(datetime AS DATE) AS day, prn, count(*) AS n, count(*) FILTER (starts_with(ascii_message, 'TEXT')) AS k FROM log GROUP BY 1, 2) "
    f"SELECT day, prn, k, c.n AS n, round({sql_binomial_sf('(k - 1)', 'c.n', 'p')}, 6) AS p_value FROM c, t",
)
def entity_share_tests(spark, sf):
    """How probable as many texts among an entity's observations of a day are by the share of texts overall."""
    is_text = F.count(F.when(F.startswith("ascii_message", F.lit("TEXT")), 1))
    rows = log(spark, sf, "ascii_message")
    overall = rows.agg((is_text / F.count(F.lit(1))).alias("p"))
    c = rows.groupBy(F.to_date("datetime").alias("day"), "prn").agg(F.count(F.lit(1)).alias("n"), is_text.alias("k"))
    return c.join(F.broadcast(overall)).select("day", "prn", "k", "n", p6(stats.binomial_sf(F.col("k") - 1, F.col("n"), F.col("p")), "p_value"))


@R.query(
    "birthday_collisions",
    LOG + ", c AS (SELECT prn, count(*)::DOUBLE AS n FROM log GROUP BY prn), t AS (SELECT count(DISTINCT message_hash)::DOUBLE AS m FROM log) SELECT prn, round(n * (n - 1) / (2 * m), 6) AS expected FROM c, t",
)
def birthday_collisions(spark, sf):
    """Pairs of equal payloads that an entity's observations would have if payloads were drawn evenly."""
    rows = log(spark, sf)
    c = rows.groupBy("prn").agg(F.count(F.lit(1)).alias("n"))
    return c.join(F.broadcast(rows.agg(F.count_distinct("message_hash").alias("m")))).select("prn", p6(stats.birthday_collisions(F.col("n"), F.col("m")), "expected"))


@R.query(
    "text_entities_tail",
    LOG + ", d AS (SELECT date_trunc('week', datetime)::TIMESTAMP AS week, prn, CAST(datetime AS DATE) AS day, bool_or(starts_with(ascii_message, 'TEXT')) AS t FROM log GROUP BY 1, 2, 3), "
    "e AS (SELECT prn, count(*) FILTER (t)::DOUBLE / count(*) AS p FROM d GROUP BY prn), w AS (SELECT week, prn, bool_or(t) AS hit FROM d GROUP BY 1, 2), "
    "g AS (SELECT week, list([1.0 - p, p] ORDER BY prn) AS ps, count(*) FILTER (hit) AS k FROM w JOIN e USING (prn) GROUP BY week), "
    "f AS (SELECT week, k, list_reduce(ps, lambda a, b: list_transform(range(1, len(a) + 2), lambda i: coalesce(a[i], 0.0) * b[1] + CASE WHEN i > 1 THEN a[i - 1] * b[2] ELSE 0.0 END)) AS dist FROM g) "
    "SELECT week, k, round(coalesce(list_sum(dist[k + 1:]), 0.0), 6) AS p_value FROM f",
)
def text_entities_tail(spark, sf):
    """Per week: entities with a text, and how probable as many are if each has texts in as large a share of weeks as of its days."""
    rows = log(spark, sf, "ascii_message")
    d = rows.groupBy(trunc_ntz("week", "datetime").alias("week"), "prn", F.to_date("datetime").alias("day")).agg(F.max(F.startswith("ascii_message", F.lit("TEXT"))).alias("t"))
    e = d.groupBy("prn").agg((F.count(F.when(F.col("t"), 1)) / F.count(F.lit(1))).alias("p"))
    w = d.groupBy("week", "prn").agg(F.max("t").alias("hit")).join(e, "prn")
    # a row per entity of one week in the list
    g = w.groupBy("week").agg(F.transform(F.sort_array(F.collect_list(F.struct("prn", "p"))), lambda x: x["p"]).alias("ps"), F.count(F.when(F.col("hit"), 1)).alias("k"))
    return g.select("week", "k", p6(stats.poisson_binomial_tail(F.col("ps"), F.col("k")), "p_value"))


@R.query(
    "entropy_effects",
    LOG + ", g AS (SELECT prn, dayofmonth(datetime) <= 15 AS early, avg(entropy) AS m, stddev_samp(entropy) AS s, count(entropy)::DOUBLE AS n FROM log WHERE entropy IS NOT NULL GROUP BY 1, 2), "
    "p AS (SELECT a.prn, a.n AS n1, b.n AS n2, b.m - a.m AS diff, sqrt(((a.n - 1) * a.s * a.s + (b.n - 1) * b.s * b.s) / nullif(a.n + b.n - 2, 0)) AS pooled FROM g a JOIN g b ON a.prn = b.prn AND a.early AND NOT b.early), "
    "d AS (SELECT prn, CASE WHEN n1 >= 2 AND n2 >= 2 AND pooled >= 1e-12 THEN diff / pooled ELSE 0.0 END AS d FROM p) "
    "SELECT prn, round(d, 6) AS effect, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS label FROM d",
)
def entropy_effects(spark, sf):
    """Cohen's d of each entity's entropies in the second half of months against the first."""
    e = log(spark, sf, "entropy").where("entropy is not null").withColumn("early", F.dayofmonth("datetime") <= 15)
    of = lambda early: [f(F.when(F.col("early") == early, F.col("entropy"))) for f in (F.avg, F.stddev_samp, F.count)]
    g = e.groupBy("prn").agg(*(c.alias(f"{n}{i}") for i, early in ((1, True), (2, False)) for n, c in zip("msn", of(early)))).where("n1 > 0 and n2 > 0")
    d = g.select("prn", stats.cohen_d(*(F.col(c) for c in ("m1", "s1", "n1", "m2", "s2", "n2"))).alias("d"))
    return d.select("prn", p6(F.col("d"), "effect"), stats.effect_label(F.col("d")).alias("label"))


@R.query(
    "normal_tails",
    LOG + ", p AS (SELECT message_hash, max(entropy) AS e FROM log WHERE entropy IS NOT NULL GROUP BY 1), s AS (SELECT avg(e) AS m, stddev_samp(e) AS s FROM p), z AS (SELECT message_hash, (e - m) / s AS z FROM p, s) "
    f"SELECT message_hash, round({sql_normal_sf('z')}, 6) AS upper_p, round(2.0 * {sql_normal_sf('abs(z)')}, 6) AS two_sided_p, round(1.0 - {sql_normal_sf('z')}, 6) AS lower_p FROM z",
)
def normal_tails(spark, sf):
    """Tail probabilities of each payload's entropy among all payloads."""
    p = log(spark, sf, "entropy").where("entropy is not null").groupBy("message_hash").agg(F.max("entropy").alias("e"))
    z = p.join(F.broadcast(p.agg(F.avg("e").alias("m"), F.stddev_samp("e").alias("s")))).select("message_hash", ((F.col("e") - F.col("m")) / F.col("s")).alias("z"))
    return z.select("message_hash", p6(stats.normal_sf(F.col("z")), "upper_p"), p6(stats.normal_two_sided(F.col("z")), "two_sided_p"), p6(stats.normal_cdf(F.col("z")), "lower_p"))


@R.query(
    "printed_numbers",
    "WITH c AS (SELECT prn, count(*) AS n, count(*) FILTER (parity_ok) AS ok FROM special_messages GROUP BY prn), t AS (SELECT sum(n)::DOUBLE AS total FROM c) "
    "SELECT prn, CASE WHEN n / total < 0.001 THEN '< 0.001' ELSE printf('%.3f', n / total) END AS share, printf('%.1f', 100.0 * ok / n) || '%' AS sound, "
    "CASE WHEN n * 38 >= 1048576 THEN printf('%.1f MB', n * 38 / 1048576.0::DOUBLE) WHEN n * 38 >= 1024 THEN printf('%.1f KB', n * 38 / 1024.0::DOUBLE) ELSE printf('%d B', n * 38) END AS frames_size FROM c, t",
)
def printed_numbers(spark, sf):
    """An entity's share of all deliveries, its sound ones in percent and the size of its frames, as reports print them."""
    c = table(spark, sf, "special_messages").groupBy("prn").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("parity_ok"), 1)).alias("ok"))
    t = c.agg(F.sum("n").cast("double").alias("total"))
    return c.join(F.broadcast(t)).select("prn", X.p_value_text(F.col("n") / F.col("total")).alias("share"), X.percent_text(F.col("ok") / F.col("n")).alias("sound"), X.size_text(F.col("n") * 38).alias("frames_size"))
