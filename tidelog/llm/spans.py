"""Long spans that stand verbatim in more than one record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidelog.operators.skew import salted_join
from tidelog.session import stage


def _repeated(windows: DataFrame, key: list[str]) -> DataFrame:
    """(rec, pos, name) of the windows (rec, pos, key) that also stand in another record; equal windows have equal names.

    Least and greatest record of a window differ exactly if two records hold it, and both combine before the
    shuffle. On the way back frequent windows are split by their counts, so that one in a third of all records
    is many tasks.
    """
    shared = windows.groupBy(*key).agg(F.min("rec").alias("a"), F.max("rec").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b")
    shared = stage(shared.select(*key, "n", F.monotonically_increasing_id().alias("name")))
    return stage(salted_join(windows, shared, key, "n", F.struct("rec", "pos")).select("rec", "pos", "name"))


def shared_spans(records: DataFrame, rec: str, content: str, min_length: int = 12, start_length: int | None = None) -> DataFrame:
    """How much of each record stands verbatim in other records, in spans of at least ``min_length`` bytes.

    ``records`` has one row per record, with an id ``rec`` of any type and binary or string ``content``; a
    string counts by its UTF-8 bytes. Each row is a record of its own, also if its id is null or repeated.
    Returns (rec, first_byte, last_byte, shared_bytes, longest_level) for records with shared bytes: the
    first and last of them counted from 1, their number, and the greatest window length of the doubling that
    still repeats. Records that are null or shorter than ``min_length`` share nothing; two rows with equal
    content share all of it. Other columns are ignored.

    Level-wise doubling: windows of ``start_length`` (half of ``min_length``) at all positions; those that
    repeat, and those alone, are extended to windows of twice the length, whose other half repeats too; and
    so on until no candidate survives. The level at ``min_length`` gives the bytes that are shared. Windows
    that repeat are named, and a longer window is known by the names of its halves, so long records compare
    two numbers at each position instead of the bytes.
    """
    length = start_length or max(1, min_length // 2)
    if min_length % length or (min_length // length) & (min_length // length - 1):
        raise ValueError("min_length must be start_length times a power of two")
    ids = stage(records.select(F.col(rec).alias("id"), F.col(content).cast("binary").alias("c")).where(f"octet_length(c) >= {min_length}").withColumn("rec", F.monotonically_increasing_id()))
    windows = F.transform(F.sequence(F.lit(1), F.octet_length("c") - length + 1), lambda i: F.substring("c", i, F.lit(length)))
    level = _repeated(ids.select("rec", F.posexplode(windows).alias("pos", "w")).withColumn("pos", F.col("pos") + 1), ["w"])
    base, tops = (level, []) if length == min_length else (None, [])
    while base is None or not level.isEmpty():
        if length >= min_length:
            tops.append(level.select("rec", F.lit(length).alias("top")).distinct())
        second = level.select("rec", (F.col("pos") - length).alias("pos"), F.col("name").alias("half2"))
        level = _repeated(level.withColumnRenamed("name", "half1").join(second.hint("merge"), ["rec", "pos"]), ["half1", "half2"])
        length *= 2
        if length == min_length:
            base = level
    tops = tops or [level.select("rec", F.lit(min_length).alias("top"))]
    longest = tops[0]
    for t in tops[1:]:
        longest = longest.unionByName(t)
    longest = longest.groupBy("rec").agg(F.max("top").alias("longest_level"))
    # each window adds the bytes that reach beyond the window before it
    added = F.least(F.lit(min_length), F.col("pos") - F.coalesce(F.lag("pos").over(W.partitionBy("rec").orderBy("pos")), F.lit(-min_length)))
    extent = base.withColumn("added", added).groupBy("rec").agg(F.min("pos").alias("first_byte"), (F.max("pos") + min_length - 1).alias("last_byte"), F.sum("added").cast("int").alias("shared_bytes"))
    return ids.select("id", "rec").join(extent.join(longest, "rec"), "rec").drop("rec").withColumnRenamed("id", rec)
