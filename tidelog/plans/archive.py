"""Queries through the sources and sinks: frame files, advisory texts, listings, checksums, reports and written logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import text as X
from tidelog.functions.frames import encode_frames, with_parsed
from tidelog.operators.ingest import decode_observations
from tidelog.plans.base import LOG, log
from tidelog.plans.registry import Registry, table
from tidelog.session import staged_path
from tidelog.sources import files as S
from tidelog.sources.advisories import missing_days, parse_advisories
from tidelog.sources.arrow_files import FrameFiles, write_frame_files

R = Registry()


def frame_rows(spark, sf):
    """The messages whose file is known as frames at the second that they can begin at."""
    m = table(spark, sf, "special_messages").where("year > 0 and day_of_year > 0 and source_file <> ''")
    at = (F.col("seconds_of_day") - F.pmod(F.col("seconds_of_day"), F.lit(6))).cast("int")
    frame = encode_frames(F.col("raw_bytes"), F.floor(at / F.lit(6)).cast("int") + 1, F.col("alert_flag"))
    return m.select(at.alias("time"), "multiplicity", frame.alias("navbits"), "year", "day_of_year", "prn", "gps_week", "source_file")


def frame_archive(spark, sf) -> str:
    """Those frames written as a folder of Arrow files, one per source file."""
    folder = staged_path(spark)
    write_frame_files(frame_rows(spark, sf), folder).write.format("noop").mode("overwrite").save()
    return folder


def read_frames(spark, folder):
    spark.dataSource.register(FrameFiles)
    return spark.read.format("frame_files").load(folder)


_KNOWN = "special_messages WHERE year > 0 AND day_of_year > 0 AND source_file <> ''"


@R.query(
    "frame_files_read",
    f"SELECT source_file, min(year) AS year, min(day_of_year) AS day_of_year, min(prn) AS prn, min(gps_week) AS gps_week, count(*) AS frames, CAST(min(seconds_of_day // 6 * 6) AS INTEGER) AS first_second, CAST(sum(multiplicity) AS BIGINT) AS receivers FROM {_KNOWN} GROUP BY source_file",
)
def frame_files_read(spark, sf):
    """Frame files written and read again: rows and metadata of each."""
    return read_frames(spark, frame_archive(spark, sf)).groupBy("source_file").agg(
        F.min("year").alias("year"), F.min("day_of_year").alias("day_of_year"), F.min("prn").alias("prn"), F.min("gps_week").alias("gps_week"), F.count(F.lit(1)).alias("frames"), F.min("time").alias("first_second"), F.sum("multiplicity").alias("receivers")
    )


@R.query(
    "frame_files_decoded",
    f"SELECT source_file, CAST(seconds_of_day // 6 * 6 AS INTEGER) AS second, ascii_message, sha256(raw_bytes) AS message_hash, count(*) AS frames FROM {_KNOWN} GROUP BY ALL",
)
def frame_files_decoded(spark, sf):
    """The observations decoded from frame files."""
    found = decode_observations(read_frames(spark, frame_archive(spark, sf)))
    return found.groupBy("source_file", F.col("seconds_of_day").alias("second"), "ascii_message", "message_hash").agg(F.count(F.lit(1)).alias("frames"))


@R.query(
    "frames_screened",
    "SELECT obs_id, CASE obs_id % 4 WHEN 1 THEN false ELSE true END AS parity_ok, obs_id % 4 <> 2 AS special, CASE WHEN obs_id % 4 = 0 THEN hex(raw_bytes) END AS payload FROM special_messages WHERE obs_id % 4 <> 3",
)
def frames_screened(spark, sf):
    """Every message as a frame of one of four sorts: sound, a data bit of word 5 turned, another satellite's page, another subframe (not kept).

    A turned bit leaves a payload, which is left out here, as it isn't the message's.
    """
    m = table(spark, sf, "special_messages").select("obs_id", "raw_bytes")
    sort = F.pmod("obs_id", F.lit(4)).cast("int")
    frame = encode_frames(F.col("raw_bytes"), F.lit(1), sv=F.when(sort == 2, 12).otherwise(55), subframe=F.when(sort == 3, 2).otherwise(4), turned_bit=F.when(sort == 1, 130).otherwise(-1))
    seen = with_parsed(m.select("obs_id", sort.alias("sort"), frame.alias("frame")), "frame").where("f.subframe_id = 4")
    return seen.select("obs_id", "f.parity_ok", (F.coalesce(F.col("f.page_number"), F.lit(0)) == 17).alias("special"), F.when(F.col("sort") == 0, F.hex("f.payload")).alias("payload"))


def advisory_files(spark, sf):
    """(path, content): the records as the daily texts that they come from, with headings, notes and lines before and after."""
    n = table(spark, sf, "nanu_records").select("nanu_id", "msg_datetime", "prn", "nanu_type", "category", "event_start", "event_stop", "source_file").distinct()
    doy = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lpad(F.dayofyear(c).cast("string"), 3, "0"), F.lit("/"), F.date_format(c, "HHmm"))).otherwise("")
    line = F.concat(
        F.rpad("nanu_id", 14, " "), F.upper(F.date_format("msg_datetime", "ddHHmm'Z' MMM yyyy")), F.lit("    "), F.coalesce(F.lpad(F.col("prn").cast("string"), 2, "0"), F.lit("  ")), F.lit("   "), F.rpad("nanu_type", 13, " "), doy("event_start"), F.lit("-"), doy("event_stop")
    )
    # a day's advisories are one file
    day = n.groupBy("source_file").agg(F.sort_array(F.collect_list(F.struct("category", line.alias("line")))).alias("rows"))
    of = lambda c: F.array_join(F.transform(F.filter("rows", lambda r: r["category"] == c), lambda r: F.concat(F.lit("\n"), r["line"])), "")
    content = F.concat(
        F.lit("SUBJ: STATUS 2007\n1. SATELLITES\n2007001001    010000Z JAN 2007    01   OUTSIDE      -\n2. CURRENT ADVISORIES\nA. FORECASTS\nNANU MSG DATE/TIME PRN TYPE SUMMARY"), of("forecast"),
        F.lit("\nB. ADVISORIES\nno record"), of("advisory"), F.lit("\nC. GENERAL"), of("general"), F.lit("\n3. REMARKS\n2007001002    010000Z JAN 2007    01   OUTSIDE      -\n"),
    )
    return day.select(F.concat(F.lit("/archive/"), "source_file").alias("path"), content.alias("content"))


@R.query(
    "advisory_lines",
    "SELECT DISTINCT nanu_id, date_trunc('minute', msg_datetime)::TIMESTAMP AS msg_datetime, prn, nanu_type, category, date_trunc('minute', event_start)::TIMESTAMP AS event_start, date_trunc('minute', event_stop)::TIMESTAMP AS event_stop, source_file, "
    "CAST(substr(source_file, 1, 4) AS INTEGER) AS file_year FROM nanu_records WHERE msg_datetime IS NOT NULL AND category IN ('forecast', 'advisory', 'general')",
)
def advisory_lines(spark, sf):
    """Records parsed from the daily texts."""
    return parse_advisories(advisory_files(spark, sf)).distinct()


@R.query(
    "days_without_advisories",
    "WITH d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2007-01-01', TIMESTAMP '2007-12-31', INTERVAL 1 DAY)) AS DATE) AS d), h AS (SELECT DISTINCT CAST(substr(source_file, 1, 4) AS INTEGER) AS y, CAST(substr(source_file, 6, 3) AS INTEGER) AS n FROM nanu_records) "
    "SELECT CAST(extract(year FROM d) AS INTEGER) AS year, CAST(dayofyear(d) AS INTEGER) AS day_of_year FROM d WHERE NOT EXISTS (SELECT 1 FROM h WHERE y = extract(year FROM d) AND n = dayofyear(d))",
)
def days_without_advisories(spark, sf):
    have = table(spark, sf, "nanu_records").select(F.substring("source_file", 1, 4).cast("int").alias("year"), F.substring("source_file", 6, 3).cast("int").alias("day_of_year")).distinct()
    return missing_days(spark, have, 2007, 2007, "2007-12-31")


@R.query(
    "listings_parsed",
    f"WITH f AS (SELECT source_file, count(*) * 38 AS n, max(datetime) AS t FROM {_KNOWN} GROUP BY 1) "
    "SELECT substr(source_file, 1, 8) AS folder, substr(source_file, 10) AS name, date_trunc('minute', t)::TIMESTAMP AS modified, CASE WHEN n >= 1024 THEN CAST(round_even(round(n / 1024.0::DOUBLE, 1) * 1024, 0) AS BIGINT) ELSE n END AS bytes, false AS is_folder, "
    "abs(n - CASE WHEN n >= 1024 THEN round_even(round(n / 1024.0::DOUBLE, 1) * 1024, 0) ELSE n END) <= greatest(0.1 * n, 1024) AS fits FROM f",
)
def listings_parsed(spark, sf):
    """Listings of the archive's folders as a server prints them, read again, and whether a size fits the file's."""
    f = table(spark, sf, "special_messages").where("year > 0 and day_of_year > 0 and source_file <> ''").groupBy("source_file").agg((F.count(F.lit(1)) * 38).alias("n"), F.max("datetime").alias("t"))
    size = F.when(F.col("n") >= 1024, F.concat(F.round(F.col("n") / 1024.0, 1).cast("string"), F.lit("K"))).otherwise(F.col("n").cast("string"))
    entry = F.concat(F.lit('<a href="'), F.substring("source_file", 10, 100), F.lit('">file</a>  '), F.date_format("t", "yyyy-MM-dd HH:mm"), F.lit("  "), size)
    pages = f.groupBy(F.substring("source_file", 1, 8).alias("folder")).agg(F.array_join(F.collect_list(entry), "\n").alias("html"))  # a folder's listing is one page
    got = S.parse_listing(pages, "html").join(f.select(F.substring("source_file", 1, 8).alias("folder"), F.substring("source_file", 10, 100).alias("name"), "n"), ["folder", "name"])
    return got.select("folder", "name", "modified", "bytes", "is_folder", S.size_fits(F.col("n"), F.col("bytes")).alias("fits"))


@R.query(
    "checksums_of_days",
    LOG + "SELECT CAST(CAST(datetime AS DATE) AS VARCHAR) AS day, CAST(octet_length(encode(string_agg(prn || ' ' || message_hash || chr(10), '' ORDER BY datetime, prn, message_hash))) AS BIGINT) AS bytes, "
    "sha256(string_agg(prn || ' ' || message_hash || chr(10), '' ORDER BY datetime, prn, message_hash)) AS sha256 FROM log GROUP BY CAST(datetime AS DATE)",
)
def checksums_of_days(spark, sf):
    """The log written as a text file a day, and the files' sizes and SHA-256."""
    path = staged_path(spark)
    rows = log(spark, sf).select(F.to_date("datetime").cast("string").alias("day"), "datetime", "prn", "message_hash")
    lines = rows.repartition("day").sortWithinPartitions("day", "datetime", "prn", "message_hash").select("day", F.concat_ws(" ", F.col("prn").cast("string"), "message_hash").alias("value"))
    lines.write.partitionBy("day").text(path)
    return S.checksums(spark, path, "*.txt").select(F.regexp_extract("path", "day=([0-9-]+)/", 1).alias("day"), "bytes", "sha256")


@R.query(
    "report_values_read",
    LOG + "SELECT 'observations of ' || prn AS name, count(*)::DOUBLE AS value FROM log GROUP BY prn",
)
def report_values_read(spark, sf):
    """A report's figures written with thousand separators and read again."""
    path = staged_path(spark)
    c = log(spark, sf).groupBy("prn").agg(F.count(F.lit(1)).alias("n"))
    c.select(F.concat(F.lit("observations of "), F.col("prn").cast("string"), F.lit(": "), F.format_number("n", 0)).alias("value")).write.text(path)
    patterns = {f"observations of {r['prn']}": rf"^observations of {r['prn']}: ([0-9,]+)$" for r in c.select("prn").where("prn is not null").orderBy("prn").limit(64).collect()}  # the report's lines
    return S.report_values(spark, path, patterns)


@R.query(
    "observations_written",
    LOG + "SELECT CAST(extract(year FROM datetime) AS INTEGER) AS year, datetime, prn, message_hash, ascii_message FROM log",
)
def observations_written(spark, sf):
    """The log written as a table by year, twice over, and read again."""
    path = staged_path(spark)
    rows = log(spark, sf, "ascii_message").withColumn("year", F.year("datetime"))
    for _ in range(2):  # writing again replaces
        S.write_observations(rows, path)
    return spark.read.parquet(path).select("year", "datetime", "prn", "message_hash", "ascii_message")


@R.query(
    "log_text_written",
    LOG + "SELECT '[' || strftime(datetime, '%Y-%m-%d %H:%M:%S') || '] PRN ' || CASE WHEN prn < 10 THEN '0' || prn ELSE left(CAST(prn AS VARCHAR), 2) END || ': ' || ascii_message AS line FROM log",
)
def log_text_written(spark, sf):
    """The log written as lines of text and read again."""
    path = staged_path(spark)
    S.write_log_text(log(spark, sf, "ascii_message"), path)
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"))


@R.query("messages_shown", "SELECT obs_id, replace(ascii_message, '`', '''') AS shown FROM special_messages")
def messages_shown(spark, sf):
    """Texts as reports quote them, without back-ticks."""
    return table(spark, sf, "special_messages").select("obs_id", X.quotable(F.col("ascii_message")).alias("shown"))
