"""Repeated and conflicting deliveries, and tables that are updated by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def deliveries_by_source(messages: DataFrame, identifier: dict[str, Column | str], row_id: str, source: str) -> DataFrame:
    """(identifier, source, deliveries, first_id): how often each source has delivered each message, and first when."""
    keys = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in identifier.items()]
    return messages.select(*keys, F.col(source), F.col(row_id)).groupBy(*identifier, source).agg(F.count(F.lit(1)).alias("deliveries"), F.min(row_id).alias("first_id"))


def identical_deliveries(messages: DataFrame, identifier: dict[str, Column | str], row_id: str, source: str) -> DataFrame:
    """Identifiers delivered more than once: (identifier, occurrence_count, distinct_sources, source_files).

    Sources are counted per identifier first; ``source_files`` lists the distinct ones in order of their first
    delivery, all of them. A row is as long as an identifier has sources; :func:`deliveries_by_source` has them as rows.
    """
    keys = list(identifier)
    per_source = deliveries_by_source(messages, identifier, row_id, source).withColumnsRenamed({source: "_s", "deliveries": "_n", "first_id": "_first"})
    each = F.sort_array(F.collect_list(F.struct("_first", "_s")))
    several = per_source.groupBy(*keys).agg(F.sum("_n").alias("occurrence_count"), F.count(F.lit(1)).alias("distinct_sources"), each.alias("_l")).where("occurrence_count > 1")
    return several.select(*keys, "occurrence_count", "distinct_sources", F.transform("_l", lambda x: x["_s"]).alias("source_files"))


def conflicting_deliveries(log: DataFrame, entity: str = "prn", time: str = "datetime", payload: str = "message_hash", row_id: str = "obs_id", source: str = "source_file") -> DataFrame:
    """Each later payload at a time and entity that already has another, paired with the first to arrive.

    ``log`` has one row per (time, entity, payload), as exactly_once() leaves it.
    """
    first = log.groupBy(time, entity).agg(F.min_by(F.struct(F.col(payload).alias("h"), F.col(source).alias("s")), row_id).alias("_f"), F.min(row_id).alias("_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    late = log.join(first, [time, entity]).where(F.col(row_id) > F.col("_id"))
    return late.select(time, entity, F.col("_f.h").alias("existing_hash"), F.col("_f.s").alias("existing_source"), F.col(payload).alias("new_hash"), F.col(source).alias("new_source"))


def delivery_totals(messages: DataFrame, identifier: dict[str, Column | str]) -> DataFrame:
    """One row: deliveries, distinct identifiers, identifiers delivered again, and deliveries beyond the first."""
    keys = list(identifier)
    g = messages.select(*((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in identifier.items())).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("deliveries"), F.count(F.lit(1)).alias("messages"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant"))


def earliest_edition(advisories: DataFrame, key: str = "nanu_id", edition: str = "source_file") -> DataFrame:
    """One whole row per key: that of the least edition, and of equal ones the least row."""
    cols = [c for c in advisories.columns if c != key]
    return advisories.groupBy(key).agg(F.min(F.struct(edition, *(c for c in cols if c != edition))).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in cols))


def upsert(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``existing`` with rows of the same key replaced by those of ``new``; of new rows with equal keys one is kept."""
    return existing.join(new, list(key), "left_anti").unionByName(new.dropDuplicates(list(key)), allowMissingColumns=True)


def insert_new(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``existing`` with the rows of ``new`` whose key it doesn't have."""
    return existing.unionByName(new.dropDuplicates(list(key)).join(existing, list(key), "left_anti"), allowMissingColumns=True)
