"""From frames to the observation log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidelog.functions import bits, text as X
from tidelog.functions.frames import with_parsed
from tidelog.functions.timefn import from_year_day

#: The log's columns, in order.
COLUMNS = [
    "datetime", "year", "day_of_year", "seconds_of_day", "gps_week", "prn", "sv_id", "ascii_message", "raw_bytes", "message_hash", "alert_flag", "parity_ok", "multiplicity", "source_file",
    "is_likely_text", "printable_chars", "null_bytes", "entropy",
]


def decode_observations(frames: DataFrame) -> DataFrame:
    """The special messages among ``frames`` (time, multiplicity, navbits, year, day_of_year, prn, gps_week, source_file).

    A native test on a few bits passes over nearly all other frames before parity is computed, in Arrow batches. Frames that are
    null or of another size, or whose file doesn't say year and day, come out without datetime or not at all.
    """
    some = frames.where(F.octet_length("navbits") == 38).where(bits.may_be_special(F.col("navbits")))
    parsed = with_parsed(some, "navbits", "time").where("f.page_number = 17")
    rows = parsed.select("*", F.col("f.payload").alias("raw_bytes"), X.message_stats(F.col("f.payload")).alias("s"))
    at = F.when((F.col("year") > 0) & (F.col("day_of_year") > 0), from_year_day(F.nullif("year", F.lit(0)), "day_of_year", "time"))
    return rows.select(
        at.alias("datetime"), "year", "day_of_year", F.col("time").alias("seconds_of_day"), "gps_week", "prn", "f.sv_id", X.visible_nulls(X.decode_message(F.col("raw_bytes"))).alias("ascii_message"), "raw_bytes",
        X.message_hash(F.col("raw_bytes")).alias("message_hash"), "f.alert_flag", "f.parity_ok", "multiplicity", "source_file", "s.is_likely_text", "s.printable_chars", "s.null_bytes", "s.entropy",
    )


def ingest(frames: DataFrame) -> DataFrame:
    """The log of ``frames``, with each (datetime, prn, message_hash) once: that of the first file by name, first second, least multiplicity, alert off before on."""
    rows = decode_observations(frames).withColumn("_order", F.struct("source_file", "seconds_of_day", "multiplicity", "alert_flag"))
    best = rows.where("datetime is not null").groupBy("datetime", "prn", "message_hash").agg(F.min_by(F.struct(*COLUMNS), "_order").alias("_r"))
    return best.select("_r.*")
