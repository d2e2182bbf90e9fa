"""Change points of metric series, their coordination and their size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidelog.functions.stats import exact_quantiles
from tidelog.functions.timefn import DAY_US
from tidelog.operators.metrics import FLEET, relative_to_fleet
from tidelog.operators.nearby import band_join

#: The metrics in which changes are looked for; at daily granularity only those of DAILY.
METRICS = ["sentinel_fraction", "text_fraction", "observation_count", "transition_count", "unique_message_count", "mean_duration_hours"]
DAILY = ["sentinel_fraction", "text_fraction", "mean_duration_hours"]


def _level(x: np.ndarray) -> tuple[float, float]:
    """Mean and sample deviation of a reference stretch; deviation 1 where nothing varies."""
    if not len(x):
        return 0.0, 1.0
    s = float(np.std(x, ddof=1)) if len(x) > 1 else 0.0
    return float(np.mean(x)), s if s > 0 else 1.0


def cusum(values: np.ndarray, slack: float = 0.5, threshold: float = 5.0, fraction: float = 0.2, least: int = 8) -> list[int]:
    """Onsets (indices) of sustained shifts in a series without missing values, by a two-sided cumulative sum.

    The reference level is that of the first ``fraction`` of the values. Deviations beyond ``slack`` add up on
    either side; a side above ``threshold`` reports where it last left 0. After a report the level is taken
    anew from the ``fraction`` of the values after the onset (at least ``least`` of them, else it stays), so
    a lasting shift is reported once. Rounding is half to even; fewer than ``least`` values have no shifts.
    """
    x = np.asarray(values, float)
    m = len(x)
    if m < least:
        return []
    mean, dev = _level(x[: max(1, round(m * fraction))])
    found, sums, since = [], [0.0, 0.0], [0, 0]
    for k in range(m):
        z = (x[k] - mean) / dev
        for side, step in enumerate((z - slack, -z - slack)):
            grown = max(0.0, sums[side] + step)
            if grown > 0.0 and sums[side] == 0.0:
                since[side] = k
            sums[side] = grown
        if max(sums) > threshold:
            onset = since[0] if sums[0] > threshold else since[1]
            found.append(onset)
            stop = min(m, onset + 1 + max(least, round((m - onset - 1) * fraction)))
            if stop - onset - 1 >= least:
                mean, dev = _level(x[onset + 1 : stop])
            sums, since = [0.0, 0.0], [k + 1, k + 1]
    return found


def detect_shifts(series: DataFrame, keys: list[str], time: str, value: str, **options) -> DataFrame:
    """(keys, time, direction) of the shifts of each series; null and NaN values are passed over.

    ``direction`` compares the value at the onset with the mean of the first fifth. Reading ahead for the new
    level rules out a window frame, so each series is one Arrow group; series have one row per period.
    """
    rows = series.select(*keys, time, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull() & ~F.isnan(value))
    schema = rows.schema

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by(time)
        x = t[value].to_numpy()
        at = cusum(x, **options)
        start = float(np.mean(x[: max(1, round(len(x) * options.get("fraction", 0.2)))]))
        picked = t.select([*keys, time]).take(pa.array(at, pa.int64()))
        return picked.append_column("direction", pa.array(["increase" if x[i] >= start else "decrease" for i in at], pa.string()))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != value) + ", direction string"
    return rows.groupBy(*keys).applyInArrow(run, ddl)


def change_points(metrics: DataFrame, threshold: float = 5.0, coordinated: int = 8, within_days: int = 3, **options) -> DataFrame:
    """Shifts of all metrics of all entities: detected_at, granularity, prn, metric, direction, cusum_statistic, coordination.

    Observation counts of entities are taken relative to the fleet. A shift is coordinated if at least
    ``coordinated`` entities, itself included, have one of the same metric and granularity within
    ``within_days``; the fleet's rows don't count as an entity.
    """
    rel = relative_to_fleet(metrics)
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col("relative_count" if m == "observation_count" else m).cast("double").alias("value")) for m in METRICS))
    long = rel.select("granularity", "prn", "period_start", F.inline(pairs)).where((F.col("granularity") != "daily") | F.col("metric").isin(DAILY))
    found = detect_shifts(long, ["granularity", "prn", "metric"], "period_start", "value", threshold=threshold, **options).withColumnRenamed("period_start", "detected_at")
    others = found.where(F.col("prn") != FLEET).select("granularity", "metric", F.col("prn").alias("other"), F.col("detected_at").alias("other_at")).distinct()
    near = band_join(found.select("granularity", "metric", "prn", "detected_at").distinct(), others, "detected_at", "other_at", within_days * DAY_US, within_days * DAY_US, ["granularity", "metric"])
    count = near.where("other <> prn").groupBy("granularity", "metric", "prn", "detected_at").agg(F.count_distinct("other").alias("n"))
    own = F.when(F.col("prn") != FLEET, 1).otherwise(0)
    n = F.coalesce("n", F.lit(0).cast("long")) + own
    return found.join(count, ["granularity", "metric", "prn", "detected_at"], "left").select(
        "detected_at", "granularity", "prn", "metric", "direction", F.lit(threshold).alias("cusum_statistic"), ((own == 1) & (n >= coordinated)).alias("is_coordinated"), n.alias("coordinated_prn_count")
    )


def effect_sizes(points: DataFrame, metrics: DataFrame, weeks: int = 8) -> DataFrame:
    """``points`` with effect_size: |difference of means| over the pooled deviation, ``weeks`` before and from each point.

    0 if a side has fewer than 2 values or nothing varies. Points are distinct by (detected_at, granularity, prn, metric).
    """
    keys = ["granularity", "prn", "metric"]
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS))
    long = metrics.select("granularity", "prn", "period_start", F.inline(pairs)).where("value is not null")
    span = weeks * 7 * DAY_US
    near = band_join(points.select(*keys, "detected_at").distinct(), long, "detected_at", "period_start", span, span - 1, keys)
    side = lambda f, before: f(F.when((F.col("period_start") < F.col("detected_at")) == before, F.col("value")))
    s = near.groupBy(*keys, "detected_at").agg(
        *(side(f, b).alias(f"{n}{i}") for i, b in ((1, True), (2, False)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count)))
    )
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / F.nullif((F.col("n1") + F.col("n2") - 2).cast("double"), F.lit(0.0)))
    d = F.when((F.col("n1") >= 2) & (F.col("n2") >= 2) & (pooled >= 1e-12), F.abs(F.col("m2") - F.col("m1")) / F.when(pooled >= 1e-12, pooled)).otherwise(0.0)
    return points.join(s.select(*keys, "detected_at", d.alias("effect_size")), [*keys, "detected_at"], "left").withColumn("effect_size", F.coalesce("effect_size", F.lit(0.0)))


def nearest_rank_threshold(df: DataFrame, value: str, share: float) -> DataFrame:
    """The rows whose value is at least the nearest-rank percentile (the ceil(share * n)-th smallest value)."""
    cut = exact_quantiles(df, value, [share], discrete=True).select(F.col("q")[0].alias("_cut"))
    return df.join(F.broadcast(cut)).where(F.col(value) >= F.col("_cut")).drop("_cut")
