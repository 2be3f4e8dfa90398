"""Syslog lines, priorities and tags as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.text import MARK, UNKNOWN, clean, or_unknown, strip
from tidelog.functions.time import with_timestamp

# Severities 0 to 7, facilities 0 to 23, and other names of severities.
SEVERITIES = ("emergency", "alert", "critical", "error", "warning", "notice", "info", "debug")
FACILITIES = (
    "kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp",
    "ntp", "audit", "alert", "clock", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
)
SEVERITY_NAMES = {"emerg": "emergency", "panic": "emergency", "crit": "critical", "err": "error", "warn": "warning", "informational": "info", "information": "info"}

# The shapes of lines.
_RFC5424 = r"(?sU)^<(\d{1,3})>\d+ (\S+) (\S+) (\S+) (\S+) \S+ (.*)$"
_RFC3164 = r"(?sU)^(?:<(\d{1,3})>)?([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:]+):\s?(.*)$"
_ISO_LINE = r"(?sU)^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d)?)\s+(\S+)\s+([^:]+):\s?(.*)$"
_BARE = r"(?sU)^([\w./@-]+(?:\[\d+\])?):\s*(.*)$"
_TAG = r"(?U)^([^\s\[\]:]+)(?:\[(\d+)\])?$"


def _coded(value: Column, names: tuple[str, ...], other: dict[str, str]) -> Column:
    text = F.lower(clean(value))
    number = F.when(text.rlike(r"^\d{1,9}$"), text).try_cast("int")
    spelled = F.lit(None).cast("string")
    for short, name in other.items():
        spelled = F.when(text == short, name).otherwise(spelled)
    by_number = F.when(number < len(names), F.get(F.array(*map(F.lit, names)), number))
    return F.coalesce(by_number, spelled, or_unknown(text))


def normalize_severity(value: Column) -> Column:
    """A severity's name from its name, number or short form; other labels stay, empty is unknown."""
    return _coded(value, SEVERITIES, SEVERITY_NAMES)


def normalize_facility(value: Column) -> Column:
    return _coded(value, FACILITIES, {})


def split_tag(tag: Column) -> Column:
    """struct(process, pid) of ``name[pid]``; a tag of another shape is all name."""
    text = strip(tag)
    named = text.rlike(_TAG)
    return F.struct(
        F.when(named, F.regexp_extract(text, _TAG, 1)).otherwise(or_unknown(text)).alias("process"),
        F.when(named, F.regexp_extract(text, _TAG, 2)).otherwise("").alias("pid"),
    )


def strip_structured_data(tail: Column) -> Column:
    """What follows the structured data of an RFC 5424 line; an element that isn't closed takes all the rest."""
    elements = r"(?s)^(?:\[(?:\\.|[^\]\\])*(?:\]|\\?\z))+(?U:\s*)"
    return F.when(tail.startswith("- "), F.substring(tail, 3, 1 << 30)).when(tail == "-", "").otherwise(F.regexp_replace(tail, elements, ""))


def priority(pri: Column) -> Column:
    """struct(severity, facility) of a PRI number from 0 to 191, null otherwise."""
    n = pri.try_cast("int")  # a number stays as it is
    return F.when(
        n.between(0, 191),
        F.struct(F.get(F.array(*map(F.lit, SEVERITIES)), n % 8).alias("severity"), F.get(F.array(*map(F.lit, FACILITIES)), F.floor(n / 8).cast("int")).alias("facility")),
    )


def with_parsed_line(df: DataFrame, column: str, offset: str = "+00:00", date_order: str = "DMY", as_of_year: int | None = None, timed: Column | None = None) -> DataFrame:
    """Add line_: struct(ts, flags, host, process, pid, severity, facility, message, raw, timestamp_text) of a text column.

    RFC 5424, RFC 3164 and ISO-prefixed lines are told apart by their shape; else ``name[pid]: message`` gives a
    process, and anything else is all message. timestamp_text is null where the line holds no time. ``timed`` says for
    which rows the time is read at all.
    """
    raw, form = F.col("_raw"), F.col("_form")
    shape = lambda *parts: F.lit(MARK.join(parts))
    p = lambda k: F.get("_line_parts", k)
    # In steps: each names what the one before has made, so that no expression is written out many times. A line that fits
    # is rewritten once, as the number of its shape, PRI, time, host, tag, pid and the rest.
    df = df.withColumn("_raw", strip(F.coalesce(F.col(column), F.lit(""))))
    told = raw
    for pattern, parts in ((_RFC5424, ("1", "$1", "$2", "$3", "$4", "$5", "$6")), (_RFC3164, ("2", "$1", "$2", "$3", "$4", "", "$5")), (_ISO_LINE, ("3", "", "$1", "$2", "$3", "", "$4")), (_BARE, ("4", "", "", "", "$1", "", "$2"))):
        told = F.regexp_replace(told, F.lit(pattern), shape(*parts))
    df = df.withColumn("_told", told)
    df = df.withColumn("_line_parts", F.when(F.col("_told") != raw, F.split("_told", MARK, 7))).withColumn("_form", F.coalesce(p(0).try_cast("int"), F.lit(0)))
    own = lambda k: F.when(form == 1, clean(p(k))).otherwise(F.coalesce(p(k), F.lit("")))
    time = F.when(form.between(1, 3), p(2))
    df = df.select(
        "*",
        time.alias("_time"),
        own(3).alias("_host"),
        own(4).alias("_tag"),
        own(5).alias("_pid"),
        p(1).try_cast("int").alias("_pri"),
        F.coalesce(p(6), raw).alias("_rest"),
        (time if timed is None else F.when(timed, time)).alias("_read_time"),
    )
    tag, pri = split_tag(F.col("_tag")), priority(F.col("_pri"))
    df = df.withColumn("_message", F.when(form == 1, strip_structured_data(F.col("_rest"))).otherwise(F.col("_rest")))
    df = with_timestamp(df, "_at", "_read_time", offset, date_order, as_of_year)
    line = F.struct(
        F.col("_at.ts").alias("ts"),
        F.col("_at.flags").alias("flags"),
        or_unknown(F.col("_host")).alias("host"),
        F.when(form == 1, or_unknown(F.col("_tag"))).when(form >= 2, tag["process"]).otherwise(UNKNOWN).alias("process"),
        F.when(form >= 2, tag["pid"]).otherwise(F.col("_pid")).alias("pid"),
        F.coalesce(pri["severity"], F.lit(UNKNOWN)).alias("severity"),
        F.coalesce(pri["facility"], F.lit(UNKNOWN)).alias("facility"),
        F.col("_message").alias("message"),
        raw.alias("raw"),
        F.col("_time").alias("timestamp_text"),
    )
    return df.withColumn("line_", line).drop("_raw", "_told", "_line_parts", "_form", "_time", "_read_time", "_host", "_tag", "_pid", "_pri", "_rest", "_message", "_at")
