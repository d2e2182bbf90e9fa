"""Joins to a keyed table when some keys hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def salted_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], count: str, by: Column, share: int = 1000) -> DataFrame:
    """``rows`` joined to ``table``, which has unique ``keys`` and in ``count`` how many rows have each of them.

    A key with at least one ``share``-th of the counted rows is split, so that none of its parts has more; ``by``
    says which part a row belongs to. Fewer than ``share`` + 1 keys can be that frequent, so their list may be
    broadcast, and only they are copied. ``count`` is read twice: give a staged table. ``table`` keeps its other
    columns, without ``count``. Rows without a partner, or with a null in a key, drop out.
    """
    part = table.agg(F.ceil(F.sum(count) / F.lit(share)).alias("_part"))  # one row
    sized = table.join(F.broadcast(part)).withColumn("_parts", F.ceil(F.col(count) / F.col("_part")))
    hot = F.broadcast(sized.where("_parts > 1").select(*keys, "_parts"))
    salt = F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1).cast("long")))
    salted = rows.join(hot, list(keys), "left").withColumn("_salt", salt).drop("_parts")
    copies = sized.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop(count, "_part", "_parts")
    # names and hashes compress so well that Spark would take their table for a small one and broadcast it
    return salted.join(copies.hint("merge"), [*keys, "_salt"]).drop("_salt")
