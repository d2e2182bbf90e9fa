"""Around the archive: listings, checksums, report values; and how the log is written."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidelog.functions.text import log_line, parse_size
from tidelog.sources.arrow_files import filesystem

# Fixed value: a row of a directory listing, with link, time and size.
LISTED = r'<a href="([^"?]+)">[^<]*</a>\s*(?:</td><td[^>]*>)?\s*(\d{4}-\d{2}-\d{2} \d{2}:\d{2})\s*(?:</td><td[^>]*>)?\s*([0-9.]+[KMGT]?|-)'


def parse_listing(pages: DataFrame, html: str) -> DataFrame:
    """``pages`` with one row for each entry of a directory listing: name, modified, bytes (null for a folder), is_folder."""
    entries = pages.withColumn("_e", F.explode(F.regexp_extract_all(html, F.lit(LISTED), F.lit(0))))
    part = lambda i: F.regexp_extract("_e", LISTED, i)
    return entries.select(*pages.columns, part(1).alias("name"), F.try_to_timestamp(part(2), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz").alias("modified"), parse_size(part(3)).alias("bytes"), F.endswith(part(1), F.lit("/")).alias("is_folder")).drop("_e")


def size_fits(expected: Column, found: Column, tolerance: float = 0.1, at_least: int = 1024) -> Column:
    """Whether a file is as large as its listing says, give or take a share, which is at least some bytes."""
    return F.abs(found - expected) <= F.greatest(expected * tolerance, F.lit(float(at_least)))


def checksums(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of the files below a folder, read piece by piece, so a file may have any size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", F.col("length").alias("bytes"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path in b.column(0).to_pylist():
                at, name = filesystem(re.sub("^file:/+", "/", path))
                digest = hashlib.sha256()
                with at.open_input_stream(name, compression=None) as f:
                    while part := f.read(1 << 22):
                        digest.update(part)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], ["path", "bytes", "sha256"])

    return files.mapInArrow(digests, "path string, bytes bigint, sha256 string")


def report_values(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """(name, value): the number in the first group of each pattern, of every line of a text report that has it."""
    lines = spark.read.text(path)
    found = F.array(*(F.struct(F.lit(n).alias("name"), F.regexp_extract("value", p, 1).alias("text")) for n, p in patterns.items()))
    return lines.select(F.inline(found)).where("text <> ''").select("name", F.regexp_replace("text", ",", "").cast("double").alias("value"))


def write_log_text(log: DataFrame, path: str) -> None:
    """The log as lines of text, in order of time within each file."""
    log.select("datetime", log_line(F.col("datetime"), F.col("prn"), F.col("ascii_message")).alias("value")).sortWithinPartitions("datetime").select("value").write.mode("overwrite").text(path)


def write_observations(log: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The log as Parquet, partitioned by year and clustered by entity and time inside, so that scans prune both."""
    log.withColumn("year", F.coalesce("year", F.lit(0))).repartition("year", F.col("prn"), F.to_date("datetime")).sortWithinPartitions("year", "prn", "datetime").write.mode(mode).option("compression", "zstd").partitionBy("year").parquet(path)
