"""Advisory texts: one file a day, with forecasts, advisories and general notices in its second section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidelog.functions.text import event_span, parse_span, parse_stamp

# The headings that begin and end the records, and those of their categories.
SECTION, END = r"(?i)^2\.\s+CURRENT ADVISORIES", r"(?i)^3\.\s+REMARKS"
HEADINGS = {"forecast": r"(?i)^A\.\s+FORECASTS", "advisory": r"(?i)^B\.\s+ADVISORIES", "general": r"(?i)^C\.\s+GENERAL"}


def digits(c: Column, least: int, most: int) -> Column:
    """Whether a text is a number of so many digits; false for null."""
    return F.coalesce(c.rlike(f"^[0-9]{{{least},{most}}}$"), F.lit(False))


def file_name(path: Column) -> tuple[Column, Column]:
    """(year, source_file) of a path: for '.../<year>/<day>.oa1' that year and the last two segments, else null and the last one."""
    parts = F.split(path, "/")
    last, folder = F.element_at(parts, -1), F.get(parts, F.size(parts) - 2)
    name = F.split(F.lower(last), "[.]")
    daily = digits(folder, 4, 4) & digits(F.get(name, F.lit(0)), 3, 3) & F.coalesce(F.get(name, F.lit(1)) == "oa1", F.lit(False))
    return F.when(daily, folder).cast("int"), F.when(daily, F.concat_ws("/", folder, last)).otherwise(last)


def record_fields(line: Column) -> Column:
    """struct(id, stamp, prn, kind, summary) of a line's words: a number, three words of time, perhaps an entity of at most two digits, a type and the rest.

    Null unless the line begins with a number of 4 to 10 digits and has a type.
    """
    words = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    word = lambda i: F.get(words, i)
    has_entity = digits(word(F.lit(4)), 1, 2)
    at = F.when(has_entity, 5).otherwise(4)
    fields = F.struct(
        word(F.lit(0)).alias("id"), F.concat_ws(" ", F.slice(words, 2, 3)).alias("stamp"), F.when(has_entity, word(F.lit(4))).cast("int").alias("prn"), F.upper(word(at)).alias("kind"),
        F.concat_ws(" ", F.slice(words, at + 2, F.greatest(F.size(words), F.lit(1)))).alias("summary"),
    )
    return F.when(digits(word(F.lit(0)), 4, 10) & word(at).isNotNull(), fields)


def read_advisories(spark: SparkSession, folder: str, suffix: str = "*.oa1", years: list[int] | None = None) -> DataFrame:
    """All records of all files below ``folder``; ``years`` are those of the files."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    records = parse_advisories(files)
    return records if years is None else records.where(F.col("file_year").isin(years))


def parse_advisories(files: DataFrame) -> DataFrame:
    """Records of (path, content) rows: nanu_id, msg_datetime, prn, nanu_type, category, event_start, event_stop, source_file, file_year.

    The year comes from the path, else from the subject line; a file with neither has no records. Lines outside
    the second section or before its first heading, and lines that are no record, are passed over.
    """
    path_year, short = file_name(F.col("path"))
    lines = files.select(path_year.alias("path_year"), short.alias("source_file"), "path", F.posexplode(F.split("content", r"\r?\n")).alias("no", "line"))
    by = W.partitionBy("path").orderBy("no")
    heading = F.coalesce(*(F.when(F.col("line").rlike(p), F.lit(c)) for c, p in HEADINGS.items()))
    ever = lambda p: F.max(F.when(F.col("line").rlike(p), 1).otherwise(0)).over(by)
    subject = F.element_at(F.split(F.trim("line"), r"\s+"), -1)
    said = F.when(F.startswith(F.upper("line"), F.lit("SUBJ:")) & digits(subject, 4, 4), subject.cast("int"))
    placed = lines.select(
        "*", heading.alias("heading"), ever(SECTION).alias("begun"), ever(END).alias("ended"), F.last(heading, ignorenulls=True).over(by).alias("category"),
        F.coalesce("path_year", F.first(said, ignorenulls=True).over(W.partitionBy("path"))).alias("file_year"),
    )
    inside = placed.where((F.col("begun") == 1) & (F.col("ended") == 0) & F.col("heading").isNull() & F.col("category").isNotNull() & F.col("file_year").isNotNull())
    found = inside.select("*", record_fields(F.col("line")).alias("r")).where("r is not null")
    rows = found.select(
        F.col("r.id").alias("nanu_id"), parse_stamp(F.col("r.stamp")).alias("msg_datetime"), "r.prn", F.col("r.kind").alias("nanu_type"), "category",
        event_span(parse_span(F.col("r.summary")), F.col("file_year")).alias("span"), "source_file", "file_year",
    )
    return rows.where("msg_datetime is not null").select("nanu_id", "msg_datetime", "prn", "nanu_type", "category", "span.*", "source_file", "file_year")


def missing_days(spark: SparkSession, have: DataFrame, first_year: int, last_year: int, until) -> DataFrame:
    """(year, day_of_year) of the calendar up to ``until`` (a date) that ``have`` lacks."""
    days = spark.range(1).select(F.explode(F.sequence(F.make_date(F.lit(first_year), F.lit(1), F.lit(1)), F.least(F.make_date(F.lit(last_year), F.lit(12), F.lit(31)), F.lit(until).cast("date")))).alias("d"))
    return days.select(F.year("d").alias("year"), F.dayofyear("d").alias("day_of_year")).join(have.select("year", "day_of_year"), ["year", "day_of_year"], "left_anti")
