"""Time helpers for timestamps without zone; none of them depends on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
DAY_US = 86_400_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c: Column | str) -> Column:
    """Microseconds from 1970-01-01 to a timestamp without zone, as a long."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), col(c))


def seconds(c: Column | str) -> Column:
    """Whole seconds from 1970-01-01 to a timestamp without zone."""
    return F.floor(micros(c) / F.lit(1_000_000))


def hours_between(a: Column | str, b: Column | str) -> Column:
    """Elapsed hours from a to b as a double."""
    return F.timestamp_diff("MICROSECOND", col(a), col(b)) / F.lit(3.6e9)


def days_between(a: Column | str, b: Column | str) -> Column:
    """Elapsed days from a to b as a double."""
    return F.timestamp_diff("MICROSECOND", col(a), col(b)) / F.lit(8.64e10)


def hour_boundaries(a: Column | str, b: Column | str) -> Column:
    """Number of full-hour boundaries crossed from a to b (00:59 to 01:01 is 1)."""
    return (F.floor(micros(b) / F.lit(3_600_000_000)) - F.floor(micros(a) / F.lit(3_600_000_000))).cast("long")


def trunc_ntz(unit: str, c: Column | str) -> Column:
    """date_trunc that stays a timestamp without zone; weeks begin on Monday."""
    return F.date_trunc(unit, col(c)).cast("timestamp_ntz")


def day_of_week(c: Column | str) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(col(c)) - F.lit(1)


def from_year_day(year: Column | str, day: Column | str, secs: Column | str) -> Column:
    """Timestamp of a year, a day of the year (1 is January 1st) and seconds in that day."""
    base = F.date_add(F.make_date(col(year), F.lit(1), F.lit(1)), (col(day) - 1).cast("int")).cast("timestamp_ntz")
    return base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), col(secs).cast("decimal(18,6)"))


def from_micros(c: Column | str) -> Column:
    """Timestamp without zone of microseconds since 1970-01-01."""
    c = col(c)
    day = F.floor(c / F.lit(DAY_US))
    return F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), ((c - day * F.lit(DAY_US)).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    )
