"""Queries of the training-data problems on sequences and texts: runs (3), spans (5), containers (6), mixtures (7), look-alikes (8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.llm.lookalike import canonical_texts, look_alike_classes, look_alike_pairs
from tidelog.llm.mixing import mix
from tidelog.llm.packing import pack
from tidelog.llm.runs import ConsensusCost, NeighbourCost, collapse_runs
from tidelog.llm.spans import shared_spans
from tidelog.llm.tokens import count_tokens
from tidelog.operators.delivery import one_payload
from tidelog.plans.problems import identifier
from tidelog.plans.registry import Registry, table

R = Registry()

_DIFFERING = " + ".join(f"CASE WHEN substr(hx, {2 * i + 1}, 2) <> substr(hy, {2 * i + 1}, 2) THEN 1 ELSE 0 END" for i in range(22))
_RUNS = f"""
    WITH once AS (SELECT * FROM (SELECT prn, datetime, raw_bytes, row_number() OVER (PARTITION BY datetime, prn, lower(message_hash) ORDER BY obs_id) AS r FROM special_messages) WHERE r = 1),
         pairs AS (SELECT prn, datetime, hex(raw_bytes) AS hx, lag(hex(raw_bytes)) OVER w AS hy, lag(datetime) OVER w AS prev FROM once WINDOW w AS (PARTITION BY prn ORDER BY datetime, raw_bytes)),
         cuts AS (SELECT prn, datetime, CASE WHEN prev IS NOT NULL AND datetime - prev <= INTERVAL 6 HOUR AND {_DIFFERING} <= 2 THEN 0 ELSE 1 END AS cut, hx FROM pairs),
         runs AS (SELECT *, sum(cut) OVER (PARTITION BY prn ORDER BY datetime, hx ROWS UNBOUNDED PRECEDING) AS run FROM cuts),
         found AS (SELECT prn, epoch_us(min(datetime)) AS a, epoch_us(max(datetime)) AS b, count(*) AS events FROM runs GROUP BY prn, run)
"""


def _runs(spark, sf, cost=NeighbourCost):
    events = one_payload(table(spark, sf, "special_messages"), identifier(), "obs_id", ["raw_bytes"])
    return collapse_runs(events, "prn", "datetime", "raw_bytes", cost=cost)


@R.query("p3_found", _RUNS + "SELECT prn, a // 1000000 AS start_s, b // 1000000 AS stop_s FROM found WHERE events >= 3")
def p3_found(spark, sf):
    second = lambda c: F.floor(F.col(c) / F.lit(1_000_000))
    return _runs(spark, sf).where("events >= 3").select("prn", second("start_us").alias("start_s"), second("stop_us").alias("stop_s"))


@R.query("p3_run_lengths", _RUNS + "SELECT prn, events, count(*) AS runs, CAST(sum(b - a) AS BIGINT) AS duration_us FROM found GROUP BY prn, events")
def p3_run_lengths(spark, sf):
    return _runs(spark, sf).groupBy("prn", "events").agg(F.count(F.lit(1)).alias("runs"), F.sum("duration_us").alias("duration_us"))


@R.query("p3_consensus_runs")
def p3_consensus_runs(spark, sf):
    """Runs of the least total of boundaries and of bytes that differ from the run's representative."""
    return _runs(spark, sf, ConsensusCost).groupBy("prn", "events").agg(F.count(F.lit(1)).alias("runs"), F.sum("duration_us").alias("duration_us"))


_SPANS = """
    WITH rec AS (SELECT lower(message_hash) AS message_hash, hex(any_value(raw_bytes)) AS h FROM special_messages GROUP BY 1),
         win AS (SELECT message_hash, p, substr(h, 2 * p - 1, 24) AS w FROM rec, generate_series(1, 11) AS g(p)),
         rep AS (SELECT w FROM win GROUP BY w HAVING count(DISTINCT message_hash) > 1),
         hit AS (SELECT message_hash, p FROM win SEMI JOIN rep USING (w))
"""


def _spans(spark, sf):
    rows = table(spark, sf, "special_messages").select("raw_bytes", F.lower("message_hash").alias("message_hash")).where("raw_bytes is not null").distinct()
    return shared_spans(rows.groupBy("raw_bytes").agg(F.min("message_hash").alias("message_hash")), "message_hash", "raw_bytes", min_length=12)


@R.query("p5_found", _SPANS + "SELECT message_hash, CAST(min(p) AS INTEGER) AS first_byte, CAST(max(p) + 11 AS INTEGER) AS last_byte FROM hit GROUP BY message_hash")
def p5_found(spark, sf):
    return _spans(spark, sf).select("message_hash", "first_byte", "last_byte")


@R.query(
    "p5_extent",
    _SPANS + ", byt AS (SELECT DISTINCT message_hash, unnest(generate_series(p, p + 11)) AS b FROM hit), cnt AS (SELECT message_hash, count(*) AS n FROM byt GROUP BY 1) "
    "SELECT CAST(n AS INTEGER) AS shared_bytes, count(*) AS records FROM cnt GROUP BY 1",
)
def p5_extent(spark, sf):
    return _spans(spark, sf).groupBy("shared_bytes").agg(F.count(F.lit(1)).alias("records"))


def _counted(spark, sf, *columns):
    docs = table(spark, sf, "documents").select("doc_id", "text", *columns)
    return docs.select("doc_id", *columns, count_tokens("text").alias("tokens"))


def _packed(spark, sf):
    return pack(_counted(spark, sf), "doc_id", "tokens", table(spark, sf, "pack_limits"))


@R.query("p6_containers")
def p6_containers(spark, sf):
    return _packed(spark, sf)


@R.query("p6_fill")
def p6_fill(spark, sf):
    """Room used in each kind of container, and the least number of containers that could do."""
    used = _packed(spark, sf).groupBy("container", "capacity", "grp", "bin").agg(F.sum("units").alias("used"))
    whole = used.groupBy("container", "capacity").agg(F.count(F.lit(1)).alias("bins"), F.sum("used").alias("tokens"), F.min(F.col("capacity") - F.col("used")).alias("least_room"))
    return whole.withColumn("least_bins", F.ceil(F.col("tokens") / F.col("capacity"))).withColumn("fill", F.col("tokens") / (F.col("bins") * F.col("capacity")))


def _mixed(spark, sf):
    return mix(_counted(spark, sf, "source"), "doc_id", "source", "tokens", table(spark, sf, "mix_targets"))


@R.query("p7_mixture")
def p7_mixture(spark, sf):
    return _mixed(spark, sf)[0]


@R.query("p7_shares")
def p7_shares(spark, sf):
    return _mixed(spark, sf)[1]


@R.query("p8_found")
def p8_found(spark, sf):
    return look_alike_pairs(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


@R.query("p8_classes")
def p8_classes(spark, sf):
    """The same in a row per document: its class, the size of it, and the documents in it that differ as stored."""
    return look_alike_classes(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


@R.query("p8_canonical")
def p8_canonical(spark, sf):
    return canonical_texts(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "canonical", (F.col("canonical") != F.col("text")).alias("changed"))
