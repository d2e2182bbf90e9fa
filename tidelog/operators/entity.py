"""Which entities share which payloads: inventories, exclusivity, overlap, rarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def entity_payloads(log: DataFrame, entity: str = "prn", time: str = "datetime", payload: str = "message_hash") -> DataFrame:
    """(entity, payload, observations, first_seen, last_seen): which payloads each entity has, a row for each."""
    return log.groupBy(entity, payload).agg(F.count(F.lit(1)).alias("observations"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))


def payload_inventory(log: DataFrame, entity: str = "prn", time: str = "datetime", payload: str = "message_hash") -> DataFrame:
    """Per entity: number of distinct payloads, observations, first and last time.

    The payloads themselves are rows of :func:`entity_payloads`; a list per entity would grow without bound.
    """
    each = entity_payloads(log, entity, time, payload)
    return each.groupBy(entity).agg(F.count(F.lit(1)).alias("unique_messages"), F.sum("observations").alias("total_observations"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def exclusive_payloads(log: DataFrame, max_entities: int = 3, entity: str = "prn", payload: str = "message_hash") -> DataFrame:
    """Payloads on at most ``max_entities`` entities, with the sorted entities and the observations."""
    each = log.groupBy(payload, entity).agg(F.count(F.lit(1)).alias("n"))
    few = each.groupBy(payload).agg(F.count(F.lit(1)).alias("prn_count"), F.sum("n").alias("observation_count")).where(F.col("prn_count") <= max_entities)
    return few.join(each.select(payload, entity), payload).groupBy(payload, "prn_count", "observation_count").agg(F.sort_array(F.collect_list(entity)).alias("prns"))


def conflicting_times(log: DataFrame, entity: str = "prn", time: str = "datetime", payload: str = "message_hash") -> DataFrame:
    """Times at which an entity has more than one distinct payload."""
    return log.groupBy(time, entity).agg(F.count_distinct(payload).alias("messages")).where("messages > 1")


def payload_rarity(log: DataFrame, entity: str = "prn", time: str = "datetime", payload: str = "message_hash", text: str = "ascii_message") -> DataFrame:
    """Per payload: observations, distinct entities and days, first and last time, and the cube root of the counts' product."""
    each = log.groupBy(payload, entity, F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("a"), F.max(time).alias("b"), F.min(text).alias("t"))
    r = each.groupBy(payload).agg(
        F.sum("n").alias("observation_count"), F.count_distinct(entity).alias("prn_count"), F.count_distinct("day").alias("day_count"), F.min("a").alias("first_seen"), F.max("b").alias("last_seen"), F.min("t").alias("ascii_message")
    )
    product = F.col("observation_count").cast("double") * F.col("prn_count") * F.col("day_count")
    return r.withColumn("rarity_score", F.cbrt(product))


def rarity_by_entity(log: DataFrame, below: int = 100, entity: str = "prn", payload: str = "message_hash") -> DataFrame:
    """Per entity: distinct payloads, how many of them are rare (fewer than ``below`` observations overall), and their share."""
    each = log.groupBy(payload, entity).agg(F.count(F.lit(1)).alias("n"))
    total = each.groupBy(payload).agg(F.sum("n").alias("total"))
    return each.join(total, payload).groupBy(entity).agg(
        F.count(F.lit(1)).alias("total_unique_messages"), F.count(F.when(F.col("total") < below, 1)).alias("rare_messages"), F.count(F.when(F.col("total") >= below, 1)).alias("common_messages"),
        (F.count(F.when(F.col("total") < below, 1)) / F.count(F.lit(1))).alias("rare_ratio"),
    )


def entity_overlap(log: DataFrame, entity: str = "prn", payload: str = "message_hash") -> DataFrame:
    """Each two entities: payloads in both, only in the first, only in the second, in either; and their Jaccard similarity.

    The pairs of entities are the result itself; those in common come from a join on the payload of distinct
    (entity, payload), which has at most entities squared times payloads rows and combines before its shuffle.
    """
    each = log.where(F.col(entity).isNotNull() & F.col(payload).isNotNull()).select(F.col(entity).alias("prn"), F.col(payload).alias("h")).distinct()
    sizes = each.groupBy("prn").agg(F.count(F.lit(1)).alias("n"))
    common = each.select("h", F.col("prn").alias("prn1")).join(each.select("h", F.col("prn").alias("prn2")), "h").where("prn1 < prn2").groupBy("prn1", "prn2").agg(F.count(F.lit(1)).alias("common"))
    # entities are numbered in order, so each one's partners are a sequence of numbers
    numbered = sizes.select("prn", "n", F.row_number().over(W.orderBy("prn")).alias("no"))
    most = numbered.agg(F.max("no").alias("most"))
    a = numbered.join(F.broadcast(most)).where("no < most").select(F.col("prn").alias("prn1"), F.col("n").alias("n1"), F.explode(F.sequence(F.col("no") + 1, F.col("most"))).alias("no"))
    pairs = a.join(numbered.select("no", F.col("prn").alias("prn2"), F.col("n").alias("n2")), "no").drop("no").join(common, ["prn1", "prn2"], "left").withColumn("common", F.coalesce("common", F.lit(0).cast("long")))
    union = F.col("n1") + F.col("n2") - F.col("common")
    return pairs.select("prn1", "prn2", "common", (F.col("n1") - F.col("common")).alias("only_first"), (F.col("n2") - F.col("common")).alias("only_second"), union.alias("either"), (F.col("common") / union).alias("jaccard"))
