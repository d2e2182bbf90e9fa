"""Context models, repeated substrings and byte statistics of payloads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidelog.functions.text import bytes_of
from tidelog.operators.baseline import draw_block, random_bits  # noqa: F401
from tidelog.operators.compression import leave_one_out_bits, walk_bits  # noqa: F401
from tidelog.session import stage


def contexts(payloads: DataFrame, payload_id: str, data: str, max_order: int = 8) -> DataFrame:
    """(id, pos, ord, ctx, sym): each byte with each of the contexts of 0 to ``max_order`` bytes before it."""
    named = payloads.select(F.col(payload_id).alias("id"), F.col(data).alias("d"))
    each = named.select("id", "d", F.posexplode(bytes_of(F.col("d"))).alias("pos", "sym"))
    orders = each.select("id", "d", "pos", "sym", F.explode(F.sequence(F.lit(0), F.least(F.lit(max_order), F.col("pos")))).alias("ord"))
    return orders.select("id", "pos", "ord", F.expr("substring(d, pos - ord + 1, ord)").alias("ctx"), "sym")


def context_model(payloads: DataFrame, payload_id: str, data: str, max_order: int = 8) -> DataFrame:
    """The model as a table (ord, ctx, sym, cnt)."""
    return contexts(payloads, payload_id, data, max_order).groupBy("ord", "ctx", "sym").agg(F.count(F.lit(1)).alias("cnt"))


def repeated_substrings(payloads: DataFrame, payload_id: str, data: str, min_length: int = 6) -> DataFrame:
    """(substring, length, messages, occurrences) of the maximal byte strings that stand in at least two payloads.

    A string is listed if one of its occurrences isn't inside a longer listed one; that is so exactly if the
    occurrence can't be extended by one byte on either side to a string that two payloads share.

    A shared string's beginnings are shared too, so windows of ``min_length`` bytes are doubled in length where
    they are shared, as long as any are; a position then takes part with lengths below its first window that is
    not. Only those are looked at one by one, so no length is given beforehand.
    """
    ids = payloads.select(F.col(payload_id).alias("id"), F.col(data).alias("d")).where(F.octet_length("d") >= min_length)
    at = ids.select("id", "d", F.explode(F.sequence(F.lit(1), F.octet_length("d") - min_length + 1)).alias("pos")).withColumn("end", F.octet_length("d") - F.col("pos") + 1)
    parts, length = None, min_length
    while True:
        windows = at.withColumn("substring", F.expr(f"substring(d, pos, {length})"))
        at = stage(windows.join(shared_by_two(windows), "substring", "left_semi").select("id", "d", "pos", "end"))
        if at.isEmpty():
            break
        # lengths from this window's to below the next one's; those not shared drop out below
        level = at.withColumn("len", F.explode(F.sequence(F.lit(length), F.least(F.lit(2 * length - 1), F.col("end")))))
        parts = level if parts is None else parts.unionByName(level)
        length *= 2
        at = at.where(F.col("end") >= length)
    if parts is None:
        return at.select(F.col("d").alias("substring"), F.lit(0).alias("length"), F.lit(0).cast("long").alias("messages"), F.lit(0).cast("long").alias("occurrences"))
    spans = parts.select("id", "pos", "len", F.expr("substring(d, pos, len)").alias("substring"))
    occ = stage(spans.join(shared_by_two(spans), "substring", "left_semi"))
    longer = occ.select("id", "pos", "len").where(F.col("len") > min_length)
    inside = longer.select("id", "pos", (F.col("len") - 1).alias("len")).unionByName(longer.select("id", (F.col("pos") + 1).alias("pos"), (F.col("len") - 1).alias("len")))
    bare = occ.join(inside, ["id", "pos", "len"], "left_anti").select("substring").distinct()
    return occ.join(bare, "substring", "left_semi").groupBy("substring").agg(F.octet_length(F.first("substring")).alias("length"), F.count_distinct("id").alias("messages"), F.count(F.lit(1)).alias("occurrences"))


def shared_by_two(spans: DataFrame) -> DataFrame:
    """The substrings that stand in at least two payloads."""
    return spans.groupBy("substring").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("substring")


def byte_histogram(payloads: DataFrame, data: str) -> DataFrame:
    """(byte, n) over all bytes of all payloads, those that never occur left out."""
    return payloads.select(F.explode(bytes_of(F.col(data))).alias("byte")).groupBy("byte").agg(F.count(F.lit(1)).alias("n"))


def alphabet_histogram(payloads: DataFrame, data: str, alphabet: list[int]) -> DataFrame:
    """(byte, n) of each byte of ``alphabet`` over all payloads, 0 for those that never occur; other bytes are left out."""
    letters = payloads.sparkSession.createDataFrame([(b,) for b in sorted(set(alphabet))], "byte int")  # at most 256
    return letters.join(byte_histogram(payloads, data), "byte", "left").select("byte", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def position_histogram(payloads: DataFrame, data: str) -> DataFrame:
    """(position, byte, n), positions counted from 1."""
    return payloads.select(F.posexplode(bytes_of(F.col(data))).alias("p", "byte")).groupBy((F.col("p") + 1).alias("position"), "byte").agg(F.count(F.lit(1)).alias("n"))


def random_payloads(spark, corpora: int, per_corpus: int, length: int, alphabet: list[int], seed: int = 42, block: int = 1000) -> DataFrame:
    """(corpus, n, data): payloads of bytes drawn evenly from ``alphabet``; each ``block`` payloads of a corpus have their own random stream."""
    blocks = max(1, -(-per_corpus // block))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, k in (divmod(i, blocks) for i in b.column(0).to_pylist()):
                first, last = k * block, min((k + 1) * block, per_corpus)
                rows = draw_block(alphabet, length, seed, c, k, last - first)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(rows), pa.int64()), pa.array(range(first, last), pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], ["corpus", "n", "data"])

    return spark.range(corpora * blocks).mapInArrow(draw, "corpus bigint, n bigint, data binary")


def peak_density(df: DataFrame, value: str, width: float = 0.5) -> DataFrame:
    """The largest share of values in one bin of ``width``, per unit."""
    bins = df.where(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / F.lit(width)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.agg((F.max("n") / (F.sum("n") * F.lit(width))).alias("peak_density"))
