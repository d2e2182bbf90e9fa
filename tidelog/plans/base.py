"""Views that the queries share: the log with each observation once, its steps, and the SQL for both."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidelog.operators.temporal import observation_steps
from tidelog.plans.registry import table
from tidelog.session import stage_once

#: The log as the reports use it: one row per (datetime, prn, message_hash), the first delivered.
LOG = """
    WITH log AS (SELECT * EXCLUDE (r, message_hash), lower(message_hash) AS message_hash FROM
        (SELECT *, row_number() OVER (PARTITION BY datetime, prn, lower(message_hash) ORDER BY obs_id) AS r FROM special_messages) WHERE r = 1)
"""
STEPS = LOG + """,
    steps AS (SELECT prn, message_hash AS from_hash, ascii_message AS from_message, datetime AS transition_time, lead(message_hash) OVER w AS to_hash,
                     lead(datetime) OVER w AS next_time, (epoch_us(lead(datetime) OVER w) - epoch_us(datetime)) / 3.6e9 AS duration_hours
              FROM log WINDOW w AS (PARTITION BY prn ORDER BY datetime, message_hash))
"""
CHANGES = STEPS + """,
    changes AS (SELECT *, (epoch_us(lead(transition_time) OVER (PARTITION BY prn ORDER BY transition_time, from_hash)) - epoch_us(transition_time)) / 3.6e9 AS held_hours
                FROM steps WHERE to_hash IS NOT NULL AND from_hash <> to_hash)
"""


_COLUMNS = ["obs_id", "source_file", "ascii_message", "raw_bytes", "entropy"]


def log(spark, sf, *columns: str) -> DataFrame:
    """The log with the key and the given columns; the first query of a session writes it, min_by combining copies before the one shuffle, and the others read it."""

    def build() -> DataFrame:
        h = F.col("message_hash")
        digits = h.rlike("^[0-9a-fA-F]{64}$")
        # 64 hex digits travel as 32 bytes; any other string as it is
        m = table(spark, sf, "special_messages").select("datetime", "prn", F.when(digits, F.unhex(h)).alias("_h"), F.when(~digits, F.lower(h)).alias("_other"), *_COLUMNS)
        first = m.groupBy("datetime", "prn", "_h", "_other").agg(F.min_by(F.struct(*_COLUMNS), "obs_id").alias("_m"))
        return first.select("datetime", "prn", F.coalesce(F.lower(F.hex("_h")), "_other").alias("message_hash"), "_m.*")

    return stage_once(spark, f"log of {sf}", build).select("datetime", "prn", "message_hash", *(c for c in _COLUMNS if c in columns))


def steps(spark, sf) -> DataFrame:
    return observation_steps(log(spark, sf, "ascii_message"))
