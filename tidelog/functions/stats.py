"""Distributions and tests as column expressions and small aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidelog.session import stage

# Coefficients of the normal distribution's polynomial approximation (Abramowitz and Stegun, 26.2.17).
NORMAL = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]


def normal_cdf(z: Column) -> Column:
    z = z.cast("double")
    t = 1.0 / (1.0 + 0.2316419 * F.abs(z))
    poly = F.lit(0.0)
    for c in reversed(NORMAL):
        poly = t * (F.lit(c) + poly)
    tail = 0.3989422804014327 * F.exp(-z * z / 2.0) * poly
    return F.when(z < -8, 0.0).when(z > 8, 1.0).when(z >= 0, 1.0 - tail).otherwise(tail)


def normal_sf(z: Column) -> Column:
    return 1.0 - normal_cdf(z)


def normal_two_sided(z: Column) -> Column:
    return 2.0 * normal_sf(F.abs(z))


def log_factorial(n: Column) -> Column:
    return F.when(n <= 1, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(n.cast("long"), F.lit(1).cast("long"))), F.lit(0.0), lambda s, i: s + F.ln(i.cast("double"))))


def poisson_pmf(k: Column, rate: Column) -> Column:
    return F.when(k < 0, 0.0).when(rate == 0, F.when(k == 0, 1.0).otherwise(0.0)).otherwise(F.exp(k * F.ln(F.when(rate > 0, rate)) - rate - log_factorial(k)))


def _summed(first: Column, last: Column, start: Column, ratio) -> Column:
    """The sum of exp(t) over first to last, where t begins with ``start`` and grows by ``ratio(i)`` from i - 1 to i: one running term."""
    state = F.struct(start.alias("t"), F.exp(start).alias("s"))
    step = lambda x, i: F.struct((x["t"] + ratio(i)).alias("t"), (x["s"] + F.exp(x["t"] + ratio(i))).alias("s"))
    more = F.when(last > first, F.sequence(first + 1, F.greatest(last, first + 1))).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.aggregate(more, state, step, lambda x: x["s"])


def poisson_cdf(k: Column, rate: Column) -> Column:
    k, rate = F.greatest(k.cast("long"), F.lit(-1).cast("long")), rate.cast("double")
    above = F.when(rate > 0, rate)
    terms = _summed(F.lit(0).cast("long"), k, -above, lambda i: F.ln(above) - F.ln(i.cast("double")))
    return F.when(k < 0, 0.0).when(rate == 0, 1.0).otherwise(F.least(terms, F.lit(1.0)))


def poisson_sf(k: Column, rate: Column) -> Column:
    return 1.0 - poisson_cdf(k, rate)


def binomial_sf(k: Column, n: Column, p: Column) -> Column:
    """P(X > k); a normal approximation with continuity correction where the variance is above 25."""
    k, n, p = k.cast("long"), n.cast("long"), p.cast("double")
    var = n * p * (1.0 - p)
    approx = normal_sf((k + 0.5 - n * p) / F.sqrt(F.when(var > 0, var)))
    inner = F.when((p > 0) & (p < 1), p)
    odds = F.ln(inner) - F.ln(1.0 - inner)
    first = F.least(F.greatest(k + 1, F.lit(0).cast("long")), n)
    start = log_factorial(n) - log_factorial(first) - log_factorial(n - first) + first * F.ln(inner) + (n - first) * F.ln(1.0 - inner)
    exact = _summed(first, n, start, lambda i: F.ln((n - i + 1).cast("double")) - F.ln(i.cast("double")) + odds)
    return F.when(k < 0, 1.0).when(k >= n, 0.0).when(p <= 0, 0.0).when(p >= 1, 1.0).when(var > 25, approx).otherwise(F.least(exact, F.lit(1.0)))


def birthday_collisions(items: Column, slots: Column) -> Column:
    return items.cast("double") * (items.cast("double") - 1.0) / (2.0 * slots.cast("double"))


def ks_p_value(d: Column, n1: Column, n2: Column) -> Column:
    """Kolmogorov's series of 100 terms with Stephens' correction."""
    root = F.sqrt(n1.cast("double") * n2 / (n1 + n2).cast("double"))
    lam = (root + 0.12 + 0.11 / root) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(d <= 0, 1.0).when(d >= 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series)))


def effect_label(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def cohen_d(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> Column:
    """Difference of means over the pooled deviation; 0 if a side has fewer than 2 values or nothing varies."""
    pooled = F.sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / F.nullif((n1 + n2 - 2).cast("double"), F.lit(0.0)))
    return F.when((n1 >= 2) & (n2 >= 2) & (pooled >= 1e-12), (m2 - m1) / F.when(pooled >= 1e-12, pooled)).otherwise(0.0)


def _value_counts(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """(v, a, b): how often each value stands in the two groups. Ranks then need one row per distinct value."""
    g = F.col(group)
    return df.where(F.col(value).isNotNull() & g.isin(first, second)).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.when(g == first, 1)).alias("a"), F.count(F.when(g == second, 1)).alias("b"))


def _running(counts: DataFrame, columns: list[str], ranges: int = 200) -> DataFrame:
    """Running totals over all values in order, without one task for all: ranges of about equal size first, then inside each."""
    marks = counts.agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 10_000).alias("m")).first()["m"] or []  # at most 199 numbers
    edges = F.array(*(F.lit(float(m)) for m in sorted(set(marks)))) if marks else F.array(F.lit(0.0))
    cut = counts.withColumn("bucket", F.size(F.filter(edges, lambda e: e < F.col("v"))))
    by = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = cut.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns)).select("bucket", *(F.coalesce(F.sum(c).over(by), F.lit(0)).alias(f"{c}_base") for c in columns))
    inside = W.partitionBy("bucket").orderBy("v")
    return cut.select("*", *(F.sum(c).over(inside).alias(f"{c}_in") for c in columns)).join(F.broadcast(base), "bucket").select("v", *columns, *((F.col(f"{c}_in") + F.col(f"{c}_base")).alias(f"{c}_run") for c in columns))


def exact_quantiles(df: DataFrame, value: str, shares: list[float], discrete: bool = False) -> DataFrame:
    """One row with an array ``q`` of the exact quantiles of a column, interpolated or (``discrete``) nearest-rank ones.

    Values are counted, so that equal ones are one row, and picked by running totals over ranges: no task holds
    all of them. Null and NaN values don't count; of none, all quantiles are null.
    """
    v = F.col(value).cast("double")
    counts = stage(df.where(F.col(value).isNotNull() & ~F.isnan(v)).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("_total"))
    at = [F.greatest(F.ceil(F.lit(s) * F.col("_total") - 1e-9) - 1, F.lit(0)).cast("double") if discrete else F.lit(s) * (F.col("_total") - 1) for s in shares]
    inside = lambda i: (F.col("n_run") - F.col("n") <= i) & (i < F.col("n_run"))
    picked = _running(counts, ["n"]).join(F.broadcast(total)).agg(
        *(F.max(F.when(inside(end(p)), F.col("v"))).alias(f"{name}{i}") for i, p in enumerate(at) for name, end in (("lo", F.floor), ("hi", F.ceil))), F.max("_total").alias("_total")
    )
    mixed = [F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (p - F.floor(p)) for i, p in enumerate(at)]
    return picked.select(F.array(*mixed).alias("q"))


def ks_test(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """One row (n1, n2, d, p_value): the two-sample Kolmogorov-Smirnov test of two groups' values."""
    counts = _value_counts(df, value, group, first, second)
    n = counts.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n1"), F.coalesce(F.sum("b"), F.lit(0)).alias("n2"))
    steps = _running(counts, ["a", "b"]).join(F.broadcast(n)).agg(F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.max(F.abs(F.col("a_run") / F.col("n1").cast("double") - F.col("b_run") / F.col("n2").cast("double"))).alias("d"))
    return steps.select("n1", "n2", "d", ks_p_value(F.col("d"), F.col("n1"), F.col("n2")).alias("p_value"))


def rank_sum_test(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """One row (n1, n2, z, p_value): the two-sided Wilcoxon rank-sum test with tie-averaged ranks and tie correction."""
    counts = _value_counts(df, value, group, first, second).withColumn("t", F.col("a") + F.col("b"))
    ranked = _running(counts, ["t"]).join(counts.select("v", "a", "b"), "v").withColumn("rank", F.col("t_run") - (F.col("t") - 1) / 2.0)
    s = ranked.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("rank") * F.col("a")).alias("r1"), F.sum(F.pow(F.col("t").cast("double"), 3.0) - F.col("t")).alias("ties"))
    n = (F.col("n1") + F.col("n2")).cast("double")
    sigma = F.sqrt(F.col("n1").cast("double") * F.col("n2") / 12.0 * (n + 1 - F.col("ties") / F.when(n > 1, n * (n - 1))))
    z = F.when(sigma > 0, (F.col("r1") - F.col("n1") * (n + 1) / 2.0) / F.when(sigma > 0, sigma)).otherwise(0.0)
    return s.select("n1", "n2", z.alias("z")).withColumn("p_value", F.when(F.col("z") == 0, 1.0).otherwise(normal_two_sided(F.col("z"))))


def chi_squared(df: DataFrame, observed: str, expected: str) -> DataFrame:
    """One row (chi2, df, z, p_value) for counts against expected counts; z standardises, p is Wilson and Hilferty's."""
    s = df.agg(F.sum(F.pow(F.col(observed) - F.col(expected), 2.0) / F.col(expected)).alias("chi2"), (F.count(F.lit(1)) - 1).alias("df"))
    k = F.col("df").cast("double")
    w = (F.cbrt(F.col("chi2") / k) - (1.0 - 2.0 / (9.0 * k))) / F.sqrt(2.0 / (9.0 * k))
    return s.where("df > 0").select("chi2", "df", ((F.col("chi2") - k) / F.sqrt(2.0 * k)).alias("z"), normal_sf(w).alias("p_value"))


def poisson_binomial_tail(probabilities: Column, at_least: Column) -> Column:
    """P(at least so many successes) of independent trials with the given array of probabilities."""
    start = F.array(F.lit(1.0))
    # the distribution of the successes so far, one trial after another
    spread = F.aggregate(
        probabilities, start, lambda d, p: F.transform(F.sequence(F.lit(0), F.size(d)), lambda i: F.coalesce(F.get(d, i), F.lit(0.0)) * (1.0 - p) + F.coalesce(F.get(d, i - 1), F.lit(0.0)) * p)
    )
    return F.aggregate(F.transform(spread, lambda x, i: F.when(i >= at_least, x).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def field_capacity_bits(symbols: int, length: int = 22) -> float:
    """Bits that a field of ``length`` symbols can hold."""
    return length * math.log2(symbols)
