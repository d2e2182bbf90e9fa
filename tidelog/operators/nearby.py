"""Joins of rows that are close in time: within a band, and nearest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidelog.functions.timefn import DAY_US, micros
from tidelog.session import stage


def band_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, back_us: int, ahead_us: int, on: Sequence[str] = (), condition: Column | None = None, how: str = "inner") -> DataFrame:
    """Pairs of rows with left_time - back_us <= right_time <= left_time + ahead_us (and equal ``on``).

    Time is cut into buckets as wide as the band: a left row looks into the two or three buckets that its
    bounds touch, so the join is an equi-join on (``on``, bucket) with the bounds as residual condition. Every
    pair meets in exactly one bucket, that of the right row. ``how`` is inner, left_semi or left_anti; column
    names of both sides must differ but for ``on``. Rows without a time match nothing.
    """
    width = max(back_us + ahead_us, 1_000_000)
    cols = list(left.columns)
    a = left.withColumn("_t", micros(left_time))
    if how != "inner":  # rows are told apart by numbers that must be the same in both uses
        a = stage(a.withColumn("_row", F.monotonically_increasing_id()))
    b = right.withColumn("_u", micros(right_time)).withColumn("_bucket", F.floor(F.col("_u") / F.lit(width)))
    wide = a.withColumn("_bucket", F.explode(F.sequence(F.floor((F.col("_t") - F.lit(back_us)) / F.lit(width)), F.floor((F.col("_t") + F.lit(ahead_us)) / F.lit(width)))))
    ok = (F.col("_u") >= F.col("_t") - F.lit(back_us)) & (F.col("_u") <= F.col("_t") + F.lit(ahead_us))
    pairs = wide.join(b, [*on, "_bucket"]).where(ok if condition is None else ok & condition)
    if how == "inner":
        return pairs.drop("_bucket", "_t", "_u")
    return a.join(pairs.select("_row").distinct(), "_row", how).select(*cols)


def nearest(left: DataFrame, right: DataFrame, left_id: str, left_time: str, right_time: str, within_us: int, on: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """For each row of ``left`` (unique ``left_id``) with any row of ``right`` within reach: the closest one, and offset_us.

    Of equally close rows the earlier one counts, then the least of the ``tie`` columns. min_by over the band
    join combines before its shuffle.
    """
    pairs = band_join(left, right, left_time, right_time, within_us, within_us, on).withColumn("offset_us", micros(right_time) - micros(left_time))
    rest = [c for c in pairs.columns if c != left_id]
    best = pairs.groupBy(left_id).agg(F.min_by(F.struct(*rest), F.struct(F.abs("offset_us").alias("d"), F.col("offset_us").alias("o"), *tie)).alias("_b"))
    return best.select(left_id, "_b.*")


def first_after(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str) -> DataFrame:
    """``left`` with the first right_time after left_time among rows with equal ``on``; null if there is none.

    The two sides are merged in order of time; the next right row is a running minimum from the end, per
    (``on``) key and 64-day slice, plus the first right row of later slices.
    """
    span = 64 * DAY_US
    keys = list(on)
    a = left.select("*", micros(left_time).alias("_t"), F.lit(None).cast("timestamp_ntz").alias(right_time), F.lit(1).alias("_side"))
    b = right.select(*keys, micros(right_time).alias("_t"), F.col(right_time), F.lit(0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_slice", F.floor(F.col("_t") / F.lit(span)))
    # at the same instant a right row is not after the left one: it sorts before it
    w = W.partitionBy(*keys, "_slice").orderBy("_t", "_side").rowsBetween(1, W.unboundedFollowing)
    later = W.partitionBy(*keys).orderBy("_slice").rowsBetween(1, W.unboundedFollowing)
    firsts = both.groupBy(*keys, "_slice").agg(F.min(right_time).alias("_first")).select(*keys, "_slice", F.min("_first").over(later).alias("_beyond"))
    out = both.withColumn("_next", F.min(right_time).over(w)).where("_side = 1").join(firsts, [*keys, "_slice"], "left")
    return out.select(*left.columns, F.coalesce("_next", "_beyond").alias(right_time))


def shuffled_times(right: DataFrame, time: str, repeats: int, seed: int = 42, shard_rows: int = 50_000) -> DataFrame:
    """The rows of ``right`` with ``rep``: as they are (rep 0), and with their times dealt anew for each repetition.

    Times are ranked by hashes of (repetition, row): inside hash ranges of about ``shard_rows`` rows, plus the
    counts of the ranges before. The row of the same number gets the time.
    """
    rows = stage(right.withColumn("_id", F.monotonically_increasing_id()))
    shards = max(1, -(-rows.count() // shard_rows))

    def ranked(df: DataFrame) -> DataFrame:
        df = df.withColumn("_h", F.xxhash64(F.lit(seed), "rep", "_id")).withColumn("_shard", F.least(F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * shards), F.lit(shards - 1)))
        df = df.withColumn("_rank", F.row_number().over(W.partitionBy("rep", "_shard").orderBy("_h", "_id")).cast("long"))
        if shards == 1:
            return df
        sums = F.sum("_n").over(W.partitionBy("rep").orderBy("_shard").rowsBetween(W.unboundedPreceding, -1))
        before = df.groupBy("rep", "_shard").agg(F.count(F.lit(1)).alias("_n")).select("rep", "_shard", F.coalesce(sums, F.lit(0)).alias("_before"))
        return df.join(before, ["rep", "_shard"]).withColumn("_rank", F.col("_rank") + F.col("_before"))

    times = ranked(rows.select("_id", time, F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("rep"))).select("rep", "_rank", time)
    numbers = ranked(rows.drop(time).withColumn("rep", F.lit(0))).drop("rep", "_id", "_h", "_shard", "_before")
    dealt = numbers.join(times, "_rank").drop("_rank")
    return stage(dealt.unionByName(rows.drop("_id").withColumn("rep", F.lit(0))))


def merged(spans: DataFrame, *keys: str) -> DataFrame:
    """(keys, a, b): the closed intervals of each key, those that meet made one."""
    by = W.partitionBy(*keys).orderBy("a", "b")
    apart = F.col("a") > F.max("b").over(by.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.select(*keys, "a", "b", F.when(apart, 1).otherwise(0).alias("_new"))
    return marked.withColumn("_k", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0))).groupBy(*keys, "_k").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_k")


def matched_by_rep(left: DataFrame, reps: DataFrame, left_key: Sequence[str], left_time: str, right_time: str, within_us: int, repeats: int, left_on: str | None = None, right_on: str | None = None, everyone: int | None = None) -> DataFrame:
    """(rep, matched): distinct left keys with a row of the same repetition of ``reps`` within reach; a key has one time and entity.

    With ``left_on`` and ``right_on`` the entities must agree; a right row of none matches all, and the left
    entity ``everyone`` is matched by all.

    No pairs are made. Times in one bucket as wide as the band reach over one stretch, from the least to the
    greatest; so a repetition has a few stretches per entity, whatever the number of right rows. Their ends are
    merged with the left rows in order of time, and running counts at the ends tell the left rows between: per
    (entity, 64-day slice), plus the counts of the slices before.
    """
    one = F.lit(0).cast("long")
    named = left.where(F.col(left_time).isNotNull()).select(*left_key, (F.col(left_on).cast("long") if left_on else one).alias("_g"), micros(left_time).alias("_t")).distinct()
    events = stage(named.select("_g", "_t"))
    own = F.col(right_on).cast("long") if right_on else one
    whom = F.array(own) if everyone is None else F.when(own.isNull(), F.array(own)).otherwise(F.array_distinct(F.array(own, F.lit(everyone).cast("long"))))
    times = reps.where(F.col(right_time).isNotNull()).select("rep", F.explode(whom).alias("_g"), micros(right_time).alias("_u"))
    spans = times.groupBy("rep", "_g", F.floor(F.col("_u") / F.lit(max(2 * within_us, 1))).alias("_bucket")).agg((F.min("_u") - within_us).alias("a"), (F.max("_u") + within_us).alias("b"))
    spans = stage(spans.drop("_bucket"))
    entities = events.where("_g is not null").select("_g").distinct()
    fleet = merged(spans.where("_g is null"), "rep").crossJoin(entities).select("rep", "_g", "a", "b")
    alone = events.where("_g is null").limit(1).select("_g").crossJoin(merged(spans.where("_g is null"), "rep")).select("rep", "_g", "a", "b")
    cover = merged(spans.join(entities, "_g", "left_semi").select("rep", "_g", "a", "b").unionByName(fleet).unionByName(alone), "rep", "_g")
    # at the same instant: a stretch's begin, left rows, a stretch's end
    ends = cover.select("rep", "_g", F.inline(F.array(F.struct(F.col("a").alias("_t"), F.lit(0).alias("_side")), F.struct(F.col("b").alias("_t"), F.lit(2).alias("_side")))))
    both = ends.unionByName(events.select(F.lit(-1).alias("rep"), "_g", "_t", F.lit(1).alias("_side"))).withColumn("_slice", F.floor(F.col("_t") / F.lit(64 * DAY_US)))
    is_left = (F.col("_side") == 1).cast("long")
    inside = F.sum(is_left).over(W.partitionBy("_g", "_slice").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0))
    earlier = F.sum("_n").over(W.partitionBy("_g").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    before = both.groupBy("_g", "_slice").agg(F.sum(is_left).alias("_n")).select(F.col("_g").alias("_h"), F.col("_slice").alias("_s"), F.coalesce(earlier, F.lit(0)).alias("_before"))
    counted = both.withColumn("_inside", inside).where("_side <> 1").join(before, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_slice") == F.col("_s")))
    hits = counted.groupBy("rep").agg(F.sum((F.col("_side") - 1) * (F.col("_inside") + F.col("_before"))).alias("matched"))
    every = left.sparkSession.range(0, repeats + 1).select(F.col("id").cast("int").alias("rep"))
    return every.join(hits, "rep", "left").select("rep", F.coalesce("matched", F.lit(0).cast("long")).alias("matched"))


def permutation_null(left: DataFrame, right: DataFrame, left_key: Sequence[str], left_time: str, right_time: str, within_us: int, repeats: int, left_on: str | None = None, right_on: str | None = None, everyone: int | None = None, seed: int = 42) -> DataFrame:
    """(rep, matched) as :func:`matched_by_rep` gives it, for the data (rep 0) and for ``repeats`` shuffles of the right times."""
    return matched_by_rep(left, shuffled_times(right, right_time, repeats, seed), left_key, left_time, right_time, within_us, repeats, left_on, right_on, everyone)


def permutation_test(counts: DataFrame, total: int) -> DataFrame:
    """One row from (rep, matched): matched, total, observed_rate, repeats, mean null_rate, and p_value, the share of shuffles that match as many or more."""
    counts = stage(counts)
    seen = counts.where("rep = 0").select(F.col("matched").alias("observed"))
    null = counts.where("rep > 0").join(F.broadcast(seen)).agg(F.max("observed").alias("matched"), F.count(F.lit(1)).alias("repeats"), F.avg("matched").alias("mean"), F.avg((F.col("matched") >= F.col("observed")).cast("int")).alias("p_value"))
    rate = lambda c: F.try_divide(F.col(c).cast("double"), F.lit(float(total)))
    return null.select("matched", F.lit(total).cast("long").alias("total"), rate("matched").alias("observed_rate"), "repeats", rate("mean").alias("null_rate"), "p_value")
