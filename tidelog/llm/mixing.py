"""Mixtures of sources with target shares of the total size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidelog.llm.packing import parameter_rows
from tidelog.session import stage

#: The golden ratio's fractional part: multiples of it, taken modulo 1, fill the unit interval evenly.
GOLDEN = 0.6180339887498949


def schedule(spark, weights: list[tuple[str, float]], slots: int, chunk: int = 65_536) -> DataFrame:
    """(slot, source, rank): a source for each slot, so that any stretch of slots holds the sources by weight.

    Slot k has the point frac(k * golden ratio), which falls into one source's part of the cumulative
    weights. Ranks count a source's slots: inside chunks, plus the counts of the chunks before.
    """
    total, at, pick = sum(w for _, w in weights), 0.0, None
    for name, w in weights[:-1]:
        at += w / total
        pick = F.when(F.col("x") < at, name) if pick is None else pick.when(F.col("x") < at, name)
    pick = F.lit(weights[-1][0]) if pick is None else pick.otherwise(weights[-1][0])
    points = spark.range(slots).select(F.col("id").alias("slot"), F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0)).alias("x"))
    named = points.select("slot", F.floor(F.col("slot") / F.lit(chunk)).alias("chunk"), pick.alias("source"))
    before = named.groupBy("source", "chunk").count().select("source", "chunk", F.coalesce(F.sum("count").over(W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1
    return named.withColumn("inside", inside).join(before, ["source", "chunk"]).select("slot", "source", (F.col("before") + F.col("inside")).alias("rank"))


def mix(
    items: DataFrame, item: str, source: str, size: str, targets: DataFrame, share: str = "target_share", repeats: str = "max_repeats", total: int | None = None, block: int = 2048, shard_rows: int = 50_000, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Combine the items of several sources so that each source has its target share of the total size.

    Returns two tables. The mixture (slot, source, item, row, copy, size) has one row per use of an item, in the
    order of ``slot``; an item is used at most ``max_repeats`` times. The report (source, target_share,
    available, mixed, actual_share, most_copies) has one row for each source of either table.

    Without ``total`` the mixture is the largest in which all targets can be met: the least of
    repeats * available / share. With a larger ``total``, sources that run out fall short, which the report
    shows. Items of null source or of sources without a target (or with share 0) have no share and stay out
    of the mixture but in the report. Items of size 0 or null go along at their place. ``targets`` is a
    parameter table (at most 1,000 rows) with one row per source; other columns of any name are ignored.

    Each source is shuffled by a hash of the item and laid out end to end, once per repeat; blocks of
    ``block`` units are its stretches between multiples of ``block``, so every block has that size up to one
    item. Block r joins the source's slot of rank r in the low-discrepancy schedule. Positions come from
    sums inside hash shards of about ``shard_rows`` rows plus the totals of the shards before, so a source
    of any size is many tasks.
    """
    spark = items.sparkSession
    wanted = {r[0]: (float(r[1] or 0), int(r[2] if r[2] is not None else 1)) for r in parameter_rows(targets.select(source, share, repeats).where(F.col(source).isNotNull()))}
    sized = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    rows = stage(items.select(F.col(item).alias("id"), F.col(source).alias("source"), sized.alias("size"), F.xxhash64(F.lit(seed), F.col(item)).alias("h"), F.monotonically_increasing_id().alias("u")))
    supply = rows.groupBy("source").agg(F.sum("size").alias("available"), F.count(F.lit(1)).alias("n"))
    have = {r["source"]: (r["available"], r["n"]) for r in parameter_rows(supply.where(F.col("source").isin(list(wanted))))}
    used = [(s, w, n) for s, (w, n) in wanted.items() if w > 0 and n > 0 and have.get(s, (0, 0))[0] > 0]
    if total is None:  # a source with a target but nothing to give leaves no total at which all targets hold; the others are mixed by their weights
        total = int(min((n * have[s][0] / w for s, w, n in used), default=0) * sum(w for _, w, _ in used))
    slots = -(-total // block) if used else 0
    weights = sorted((s, w) for s, w, _ in used)

    plan = spark.createDataFrame([(s, have[s][0], n, max(1, -(-have[s][1] // shard_rows))) for s, _, n in used], "source string, available bigint, repeats int, shards bigint")
    placed = rows.join(F.broadcast(plan), "source").withColumn("shard", F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("shards")), F.col("shards") - 1))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("n")).select("source", "shard", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = F.coalesce(F.sum("size").over(W.partitionBy("source", "shard").orderBy("h", "u").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = (
        placed.withColumn("local", local)
        .join(shards, ["source", "shard"])
        .select("source", "id", "u", "size", (F.col("before") + F.col("local")).alias("at"), "available", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)).alias("copy"))
        .select("source", "id", "u", "size", "copy", F.floor((F.col("copy") * F.col("available") + F.col("at")) / F.lit(block)).alias("rank"))
    )
    if slots:
        mixture = blocks.join(schedule(spark, weights, slots).hint("merge"), ["source", "rank"]).select("slot", "source", F.col("id").alias(item), F.col("u").alias("row"), "copy", "size")
    else:
        mixture = blocks.where("false").select(F.col("rank").alias("slot"), "source", F.col("id").alias(item), F.col("u").alias("row"), "copy", "size")
    mixture = stage(mixture)
    aims = spark.createDataFrame([(s, w) for s, (w, _) in wanted.items()], "source string, target_share double")
    got = mixture.groupBy("source").agg(F.sum("size").alias("mixed"), (F.max("copy") + 1).alias("most_copies"))
    known = supply.select("source", "available").unionByName(aims.select("source", F.lit(0).cast("long").alias("available"))).groupBy("source").agg(F.max("available").alias("available"))
    report = known.join(F.broadcast(aims), "source", "left").join(F.broadcast(got), "source", "left")
    whole = mixture.agg(F.sum("size").alias("s")).first()["s"] or 0
    zero = F.lit(0).cast("long")
    report = report.select(
        "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), "available", F.coalesce("mixed", zero).alias("mixed"),
        (F.coalesce("mixed", zero) / F.lit(float(max(whole, 1)))).alias("actual_share"), F.coalesce(F.col("most_copies").cast("long"), zero).alias("most_copies"),
    )
    return mixture, report
