"""Timestamps of log records as expressions: one pattern for each accepted shape."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.text import MARK, clean

# The accepted shapes. Each is rewritten as its number, year, month, day, hour, minute, second, fraction, half of
# the day and zone, parted by a noncharacter.
_ISO = r"^(\d{4})-(\d\d)-(\d\d)(?:[T ](\d\d)(?::(\d\d)(?::(\d\d)(?:\.(\d+))?)?)?)?\s*([+-]\d\d:?\d\d)?$"
_SLASH = r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:,\s*| )(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,6}))?)?(?: ([AaPp][Mm]))?\s*([+-]\d\d:?\d\d)?$"
_MONTH = r"^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d\d):(\d\d):(\d\d)\s*([+-]\d\d:?\d\d)?$"
_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def offset_seconds(offset: str) -> int:
    """Seconds east of UTC of ``+HH:MM``, at most 14 hours either way."""
    m = re.fullmatch(r"([+-])(\d{2}):(\d{2})", offset)
    if not m:
        raise ValueError("The offset must look like +HH:MM or -HH:MM.")
    hours, minutes = int(m[2]), int(m[3])
    if minutes > 59 or hours * 60 + minutes > 14 * 60:
        raise ValueError("The offset is out of range (14:00 at most).")
    return (hours * 3600 + minutes * 60) * (-1 if m[1] == "-" else 1)


def _zone_seconds(zone: Column, most: int) -> Column:
    """Seconds of a ``+HH:MM`` suffix; null if it is empty or out of range."""
    hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(F.regexp_replace(zone, ":", ""), 4, 2).try_cast("int")
    total = hours * 3600 + minutes * 60
    good = (zone != "") & (minutes <= 59) & (total <= most)
    return F.when(good, F.when(F.substring(zone, 1, 1) == "-", -total).otherwise(total))


def _micros(fraction: Column) -> Column:
    return F.rpad(F.substring(fraction, 1, 6), 6, "0").try_cast("int")


def _moment(year, month, day, hour, minute, second, fraction: Column) -> Column:
    """The timestamp of the parts read as UTC; null if no such time exists."""
    n = lambda c: F.coalesce(F.nullif(c, F.lit("")).try_cast("int"), F.lit(0))
    whole = F.try_make_timestamp(n(year), n(month), n(day), n(hour), n(minute), n(second).cast("decimal(16,6)"), F.lit("UTC"))
    return F.when(n(second) < 60, F.timestamp_micros(F.unix_micros(whole) + F.coalesce(_micros(fraction), F.lit(0))))


def with_timestamp(df: DataFrame, name: str, column: str, offset: str = "+00:00", date_order: str = "DMY", as_of_year: int | None = None, declared_utc: Column | bool = False) -> DataFrame:
    """Add ``name``: struct(ts, flags) of a text column: the instant in UTC and what was assumed about it.

    Accepted are ISO 8601 dates and times, dates with slashes and a 24 or 12 hour clock, and ``Mon D HH:MM:SS``
    without a year, which gets ``as_of_year`` (the current year by default). A null or empty value is
    missing_timestamp, an unreadable one invalid_timestamp. declared_utc: the column's name says UTC.
    """
    declared = F.lit(declared_utc) if isinstance(declared_utc, bool) else declared_utc
    text, form = F.col("_t_text"), F.col("_t_form")
    p = lambda k: F.get("_t_parts", k)
    shape = lambda *parts: F.lit(MARK.join(parts))
    # In steps: each names what the one before has made, so that no expression is written out many times. A value that has
    # been rewritten begins with its number and fits no other shape.
    df = df.withColumn("_t_text", F.regexp_replace(clean(F.col(column)), r"(?i)\s*(?:UTC|Z)$", "+00:00"))
    told = F.regexp_replace(text, F.lit(_ISO), shape("1", "$1", "$2", "$3", "$4", "$5", "$6", "$7", "", "$8"))
    told = F.regexp_replace(told, F.lit(_SLASH), shape("2", "$3", *(("$2", "$1") if date_order == "DMY" else ("$1", "$2")), "$4", "$5", "$6", "$7", "$8", "$9"))
    told = F.regexp_replace(told, F.lit(_MONTH), shape("3", "", "$1", "$2", "$3", "$4", "$5", "", "", "$6"))
    df = df.withColumn("_t_told", told)
    df = df.withColumn("_t_parts", F.when(F.col("_t_told") != text, F.split("_t_told", MARK))).withColumn("_t_form", F.coalesce(p(0).try_cast("int"), F.lit(0)))
    number = F.nullif(F.array_position(F.array(*map(F.lit, _MONTHS)), p(2)), F.lit(0)).cast("string")
    year = F.lit(str(as_of_year)) if as_of_year is not None else F.year(F.current_timestamp()).cast("string")
    hour, clock = p(4).try_cast("int"), F.lower(p(8))
    hour24 = F.when(clock == "", F.coalesce(hour, F.lit(0))).when(hour.between(1, 12), hour % 12 + F.when(clock == "pm", 12).otherwise(0))
    df = df.withColumn("_t_year", F.when(form == 3, year).otherwise(p(1))).withColumn("_t_month", F.when(form == 3, number).otherwise(p(2))).withColumn("_t_hour", hour24)
    moment = _moment(F.col("_t_year"), F.col("_t_month"), p(3), F.col("_t_hour").cast("string"), p(5), p(6), p(7))
    known = (form > 0) & F.col("_t_month").isNotNull() & F.col("_t_hour").isNotNull()
    df = df.withColumn("_t_moment", F.when(known, moment)).withColumn("_t_zone", F.coalesce(p(9), F.lit("")))
    seconds = F.when(form == 1, _zone_seconds(F.col("_t_zone"), 86399)).otherwise(_zone_seconds(F.col("_t_zone"), 14 * 3600))
    df = df.withColumn("_t_seconds", F.when(F.col("_t_zone") != "", seconds))
    a, b = p(3).try_cast("int"), p(2).try_cast("int")
    bare = F.col("_t_zone") == ""
    shift = F.when(~bare, F.col("_t_seconds")).when(declared, 0).otherwise(offset_seconds(offset))
    df = df.withColumn("_t_ts", F.timestamp_micros(F.unix_micros("_t_moment") - shift.cast("long") * 1_000_000))
    flags = F.array_compact(F.array(
        F.when(form == 3, "inferred_year"),
        F.when((form == 2) & a.between(1, 12) & b.between(1, 12) & (a != b), "ambiguous_date"),
        F.when(bare, F.when(declared, "column_utc").otherwise("assumed_timezone")),
        F.when(~bare & (F.col("_t_seconds") != 0) & declared, "timezone_conflict"),
    ))
    told = F.when(text == "", F.array(F.lit("missing_timestamp"))).when(F.col("_t_ts").isNull(), F.array(F.lit("invalid_timestamp"))).otherwise(flags)
    out = df.withColumn(name, F.struct(F.col("_t_ts").alias("ts"), told.alias("flags")))
    return out.drop("_t_text", "_t_told", "_t_form", "_t_parts", "_t_year", "_t_month", "_t_hour", "_t_moment", "_t_zone", "_t_seconds", "_t_ts")


def iso_utc(ts: Column) -> Column:
    """ISO 8601 text in UTC, with a fraction only where there is one. The session's time zone must be UTC."""
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
