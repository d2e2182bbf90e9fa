"""Text of messages and advisories: code page, byte statistics, formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidelog.functions.bits import let
from tidelog.functions.timefn import from_year_day

# The code page's glyphs of the bytes 1 to 31.
LOW_GLYPHS = "☺☻♥♦♣♠•◘○◙♂♀♪♫☼►◄↕‼¶§▬↨↑↓→←∟↔▲▼"
# Names of months, in order.
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def code_page() -> list[str]:
    """The character of each byte: NUL is the replacement character, 1 to 31 and 127 are glyphs, 255 is a space."""
    high = bytes(range(128, 255)).decode("cp437")
    return ["�", *LOW_GLYPHS, *map(chr, range(32, 127)), "⌂", *high, " "]


def bytes_of(data: Column) -> Column:
    """A binary's bytes as an array of ints; empty for an empty binary."""
    codes = F.transform(F.split(F.decode(data, "ISO-8859-1"), r"(?!^)(?!\z)"), F.ascii)
    return F.when(F.octet_length(data) > 0, codes).when(data.isNotNull(), F.expr("cast(array() as array<int>)"))


def decode_message(data: Column) -> Column:
    """A binary's bytes as text of the code page; null for null."""
    # each byte as the character of that number, then one translate to the code page
    latin = F.decode(data, "ISO-8859-1")
    chars = code_page()
    moved = [(chr(i), c) for i, c in enumerate(chars) if chr(i) != c]
    return F.translate(latin, "".join(a for a, _ in moved), "".join(b for _, b in moved))


def _entropy(codes: Column) -> Column:
    """Bits per byte of an array of byte values, by one walk over it in sorted order."""
    n = F.size(codes).cast("double")
    term = lambda run: run * F.log2(run)
    start = F.struct(F.lit(-1).alias("at"), F.lit(1.0).alias("run"), F.lit(0.0).alias("s"))
    step = lambda x, b: F.struct(b.alias("at"), F.when(b == x["at"], x["run"] + 1.0).otherwise(1.0).alias("run"), F.when(b == x["at"], x["s"]).otherwise(x["s"] + term(x["run"])).alias("s"))
    total = F.aggregate(F.sort_array(codes), start, step, lambda x: x["s"] + term(x["run"]))
    return F.when(n > 0, F.greatest(F.log2(n) - total / n, F.lit(0.0))).otherwise(0.0)


def entropy(data: Column) -> Column:
    """Shannon entropy in bits per byte; 0 for an empty binary."""
    return let(bytes_of(data), lambda a: F.when(a.isNotNull(), _entropy(a)))


def printable_count(data: Column) -> Column:
    return F.size(F.filter(bytes_of(data), lambda b: b.between(0x20, 0x7E)))


def null_count(data: Column) -> Column:
    return F.size(F.filter(bytes_of(data), lambda b: b == 0))


def likely_text(data: Column, printable: float = 0.70, entropy_below: float = 4.5, nulls_below: float = 0.50) -> Column:
    return let(message_counts(data), lambda c: _is_text(c, printable, entropy_below, nulls_below))


def message_counts(data: Column) -> Column:
    """struct(n, printable_chars, null_bytes, entropy), from the bytes taken apart once; null for null."""
    counts = lambda a: F.struct(F.size(a).alias("n"), F.size(F.filter(a, lambda b: b.between(0x20, 0x7E))).alias("printable_chars"), F.size(F.filter(a, lambda b: b == 0)).alias("null_bytes"), _entropy(a).alias("entropy"))
    return let(bytes_of(data), lambda a: F.when(a.isNotNull(), counts(a)))


def _is_text(c: Column, printable: float = 0.70, entropy_below: float = 4.5, nulls_below: float = 0.50) -> Column:
    n = F.nullif(c["n"], F.lit(0)).cast("double")
    return F.when(c["n"] > 0, (c["printable_chars"] / n >= printable) & (c["entropy"] < entropy_below) & (c["null_bytes"] / n < nulls_below)).when(c.isNotNull(), F.lit(False))


def message_stats(data: Column) -> Column:
    return let(message_counts(data), lambda c: F.struct(_is_text(c).alias("is_likely_text"), c["printable_chars"].alias("printable_chars"), c["null_bytes"].alias("null_bytes"), c["entropy"].alias("entropy")))


def message_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def visible_nulls(text: Column) -> Column:
    return F.translate(text, "\0", "�")


def is_sentinel(text: Column) -> Column:
    """All blanks, all NUL (shown as the replacement character) or all ¬; an empty text counts."""
    return text.rlike(r"^( *|�*|¬*)\z")


def sentinel_class(text: Column) -> Column:
    """Which of the three an all-equal text is; an empty one counts as the first."""
    return F.when(text.rlike(r"^¬*\z"), "all_aa").when(text.rlike(r"^�*\z"), "all_nul").when(text.rlike(r"^ *\z"), "all_space").otherwise("unknown")


def one_character(text: Column, length: int = 22) -> Column:
    """Whether the text is one character repeated ``length`` times."""
    return text == F.repeat(F.substring(text, 1, 1), length)


def one_byte(data: Column, length: int = 22) -> Column:
    return F.hex(data) == F.repeat(F.hex(F.substring(data, 1, 1)), length)


def log_line(at: Column, entity: Column, text: Column) -> Column:
    return F.format_string("[%s] PRN %s: %s", F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lpad(entity.cast("string"), 2, "0"), text)


def p_value_text(p: Column) -> Column:
    return F.when(p < 0.001, "< 0.001").otherwise(F.format_number(p, 3))


def percent_text(x: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(100 * x, digits), F.lit("%"))


def parse_stamp(s: Column) -> Column:
    """Timestamp of 'DDHHMMZ MON YYYY'; null if it isn't one."""
    pat = r"^\s*(\d{2})(\d{2})(\d{2})Z\s+([A-Za-z]{3})\s+(\d{4})\s*$"
    g = lambda i: F.regexp_extract(s, pat, i)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(g(4)))
    text = F.format_string("%s-%s-%s %s:%s:00", g(5), F.lpad(month.cast("string"), 2, "0"), g(1), g(2), g(3))
    return F.when(s.rlike(pat) & (month > 0), F.try_to_timestamp(text)).cast("timestamp_ntz")


def parse_span(s: Column) -> Column:
    """struct(start_doy, start_hhmm, stop_doy, stop_hhmm) of 'DOY/HHMM-DOY/HHMM', where either side may be open."""
    full = r"(\d{1,3})/(\d{4})"
    start = lambda i, kind: F.when(s.rlike(full + r"\s*-"), F.regexp_extract(s, full + r"\s*-", i)).cast(kind)
    stop = lambda i, kind: F.when(s.rlike(r"-\s*" + full), F.regexp_extract(s, r"-\s*" + full, i)).cast(kind)
    return F.struct(start(1, "int").alias("start_doy"), start(2, "string").alias("start_hhmm"), stop(1, "int").alias("stop_doy"), stop(2, "string").alias("stop_hhmm"))


def event_span(span: Column, year: Column) -> Column:
    """struct(event_start, event_stop) of a parsed span; a stop before the start lies in the next year."""
    secs = lambda hhmm: F.substring(hhmm, 1, 2).cast("int") * 3600 + F.substring(hhmm, 3, 2).cast("int") * 60
    stop_year = year + F.when(span["stop_doy"] < span["start_doy"], 1).otherwise(0)
    return F.struct(from_year_day(year, span["start_doy"], secs(span["start_hhmm"])).alias("event_start"), from_year_day(stop_year, span["stop_doy"], secs(span["stop_hhmm"])).alias("event_stop"))


def parse_size(s: Column) -> Column:
    """Bytes of a listing's size such as '1.5K', '20M' or '512'; '-' and others are null."""
    number, unit = F.regexp_extract(s, r"^\s*([0-9.]+)\s*([KMGT]?)B?\s*$", 1), F.regexp_extract(s, r"^\s*([0-9.]+)\s*([KMGT]?)B?\s*$", 2)
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).otherwise(0)
    return F.when(number != "", F.rint(F.when(number != "", number).cast("double") * F.pow(F.lit(1024.0), power.cast("double"))).cast("long"))


def size_text(n: Column) -> Column:
    out = F.format_string("%d B", n)
    for i, u in enumerate("KMGT", 1):
        out = F.when(n >= 1024**i, F.format_string(f"%.1f {u}B", n / float(1024**i))).otherwise(out)
    return out


def days_in_year(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def quotable(text: Column) -> Column:
    """A text that can stand between back-ticks."""
    return F.translate(text, "`", "'")
