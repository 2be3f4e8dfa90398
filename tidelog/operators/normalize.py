"""From records with any known header, or lines of text, to events of one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.catalog import DEFAULT, Catalog
from tidelog.functions.classify import classify, message_template
from tidelog.functions.network import clean_ip, with_endpoints
from tidelog.functions.syslog import FACILITIES, SEVERITIES, normalize_facility, normalize_severity, split_tag, with_parsed_line
from tidelog.functions.text import UNKNOWN, clean, nonempty, normal_header
from tidelog.functions.time import with_timestamp
from tidelog.operators.identity import with_first
from tidelog.schema import ALIASES, METADATA, Params

DETAIL = "array<struct<code:string,column:string,value:string>>"


def resolve(columns: list[str]) -> dict[str, list[str]]:
    """The columns that may give each field, in order of preference."""
    by_name = {normal_header(c): c for c in columns}
    return {field: [by_name[a] for a in names if a in by_name] for field, names in ALIASES.items()}


def pick(columns: list[str]) -> tuple[Column, Column, Column]:
    """(clean value, original value, column name) of the first column with a value, or of the first one."""
    if not columns:
        return F.lit(""), F.lit(""), F.lit(None).cast("string")
    if len(columns) == 1:
        return clean(F.col(f"`{columns[0]}`")), F.coalesce(F.col(f"`{columns[0]}`"), F.lit("")), F.lit(columns[0])
    value = F.coalesce(*(nonempty(clean(F.col(f"`{c}`"))) for c in columns), F.lit(""))
    which, original = F.lit(columns[0]), F.coalesce(F.col(f"`{columns[0]}`"), F.lit(""))
    for c in reversed(columns):
        has = clean(F.col(f"`{c}`")) != ""
        which, original = F.when(has, F.lit(c)).otherwise(which), F.when(has, F.coalesce(F.col(f"`{c}`"), F.lit(""))).otherwise(original)
    return value, original, which


def normalize(records: DataFrame, params: Params, keep: tuple[str, ...] = ("source", "row", "line_start", "line")) -> DataFrame:
    """Events of CSV records: a column for each header name, besides ``keep``.

    A column with a value wins over what the message says. The time is that of TimeGenerated, else of EventTime,
    else of the message; a value that can't be read is never replaced. Missing fields are ``unknown``.
    """
    fields = resolve([c for c in records.columns if c not in keep])
    picked = {f: pick(c) for f, c in fields.items()}
    staged = records.select(*keep, *(x.alias(f"{n}_{f}") for f in fields for x, n in zip(picked[f], ("v", "o", "c"), strict=True)))
    args = (params.naive_offset, params.date_order, params.as_of_year)
    # The message's time is read only where neither column has one.
    staged = with_parsed_line(staged, "v_message", *args, timed=(F.col("v_timestamp") == "") & (F.col("v_event_time") == ""))
    for name, field in (("t1", "timestamp"), ("t2", "event_time")):
        if not fields[field]:
            staged = staged.withColumn(name, F.struct(F.lit(None).cast("timestamp").alias("ts"), F.array(F.lit("missing_timestamp")).alias("flags")))
            continue
        utc = [c for c in fields[field] if normal_header(c).endswith("[utc]")]
        staged = with_timestamp(staged, name, f"v_{field}", *args, declared_utc=F.coalesce(F.col(f"c_{field}").isin(*utc), F.lit(False)) if utc else False)
    # The address is cleaned, and the process and labels told, before they are named more than once.
    staged = staged.withColumn("_ip", clean_ip(F.col("v_host_ip"))).withColumn("_tag", split_tag(F.col("v_process")))
    v = lambda f: F.col(f"v_{f}")
    first, second = v("timestamp") != "", (v("timestamp") == "") & (v("event_time") != "")
    by_line = F.col("line_.timestamp_text").isNotNull()
    fallback = F.array(F.lit("event_time_fallback"))
    time_flags = F.when(first, F.col("t1.flags")).when(second, F.concat("t2.flags", fallback)).when(by_line, F.col("line_.flags")).otherwise(F.array(F.lit("missing_timestamp")))
    process = F.when(v("process") != "", F.col("_tag")).otherwise(F.struct(F.col("line_.process").alias("process"), F.lit("").alias("pid")))
    detail = F.when(
        (v("event_time") != "") & ~second,
        F.transform("t2.flags", lambda x: F.struct(F.when(x == "invalid_timestamp", "invalid_event_time").otherwise(x).alias("code"), F.col("c_event_time").alias("column"), F.col("o_event_time").alias("value"))),
    )
    given = lambda f, own, other: F.when(v(f) != "", own).otherwise(other)
    out = staged.select(
        *keep,
        F.when(first, F.col("t1.ts")).when(second, F.col("t2.ts")).otherwise(F.col("line_.ts")).alias("timestamp"),
        F.when(first, F.col("c_timestamp")).when(second, F.col("c_event_time")).when(by_line, F.col("c_message")).otherwise(F.coalesce("c_timestamp", "c_event_time")).alias("timestamp_source"),
        F.when(first, F.col("o_timestamp")).when(second, F.col("o_event_time")).when(by_line, F.col("line_.timestamp_text")).otherwise("").alias("timestamp_original"),
        F.col("t1.ts").alias("time_generated"), F.col("t2.ts").alias("event_time"),
        given("host", v("host"), F.col("line_.host")).alias("host"),
        process["process"].alias("process"),
        F.coalesce(nonempty(v("pid")), nonempty(process["pid"]), F.col("line_.pid")).alias("pid"),
        given("severity", normalize_severity(v("severity")), F.col("line_.severity")).alias("severity"),
        given("facility", normalize_facility(v("facility")), F.col("line_.facility")).alias("facility"),
        F.coalesce(nonempty(F.col("_ip")), nonempty(v("host_ip")), F.lit(UNKNOWN)).alias("host_ip"), (F.col("_ip") != "").alias("valid_ip"),
        F.col("line_.message").alias("message"), F.col("line_.raw").alias("raw"),
        time_flags.alias("time_flags"), (v("message") == "").alias("no_message"),
        F.coalesce(detail.cast(DETAIL), F.array().cast(DETAIL)).alias("field_diagnostics"),
        F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.col(f"o_{f}") for f in fields))).alias("columns"),
        F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.col(f"c_{f}") for f in fields))).alias("column_sources"),
        F.map_filter(F.map_from_arrays(F.array(*map(F.lit, METADATA)), F.array(*(v(f) for f in METADATA))), lambda _, x: x != "").alias("metadata"),
    )
    return _flagged(out)


def normalize_lines(lines: DataFrame, params: Params) -> DataFrame:
    """Events of text lines (source, row, line_start, line, value); the same columns as ``normalize`` gives."""
    x = with_parsed_line(lines, "value", params.naive_offset, params.date_order, params.as_of_year)
    none = F.create_map().cast("map<string,string>")
    out = x.select(
        "source", "row", "line_start", "line", F.col("line_.ts").alias("timestamp"),
        F.when(F.col("line_.timestamp_text").isNotNull(), "syslog").alias("timestamp_source"),
        F.coalesce("line_.timestamp_text", F.lit("")).alias("timestamp_original"),
        F.lit(None).cast("timestamp").alias("time_generated"), F.lit(None).cast("timestamp").alias("event_time"),
        *(F.col(f"line_.{c}").alias(c) for c in ("host", "process", "pid", "severity", "facility")),
        F.lit(UNKNOWN).alias("host_ip"), F.lit(False).alias("valid_ip"), F.col("line_.message").alias("message"), F.col("line_.raw").alias("raw"),
        F.coalesce("line_.flags", F.array(F.lit("missing_timestamp"))).alias("time_flags"), F.lit(False).alias("no_message"),
        F.array().cast(DETAIL).alias("field_diagnostics"), none.alias("columns"), none.alias("column_sources"), none.alias("metadata"),
    )
    return _flagged(out, text=True)


def _flagged(events: DataFrame, text: bool = False) -> DataFrame:
    """Row flags in their fixed order, and the key of the host."""
    known = lambda c, names: F.col(c).isin(*names, UNKNOWN)
    flags = F.array_compact(F.array(
        F.when(~known("severity", SEVERITIES) & F.lit(not text), "unrecognized_severity"),
        F.when(~known("facility", FACILITIES) & F.lit(not text), "unrecognized_facility"),
        F.when(F.col("no_message"), "missing_message"),
        F.when((F.col("host_ip") != UNKNOWN) & ~F.col("valid_ip"), "invalid_host_ip"),
    ))
    key = F.when(F.col("host") != UNKNOWN, F.col("host")).when(F.col("valid_ip"), F.col("host_ip"))
    return events.withColumn("flags", F.concat("time_flags", flags)).withColumn("host_key", key).drop("time_flags", "no_message", "valid_ip")


def with_identity_flags(events: DataFrame, scope: tuple[str, ...] = ("source",)) -> DataFrame:
    """Flag records equal to an earlier one of their scope, and records without host or process.

    Equality is told by 128 bits of hash of the eight fields. Lines that stand alone, and a line that makes up much of the
    data, are not shuffled whole (``identity.with_first``). Events are read three times: they should be a stored table.
    """
    fields = ["timestamp", "host", "host_ip", "process", "pid", "facility", "severity", "raw"]
    marked = events.withColumn("_h1", F.xxhash64(*scope, *fields)).withColumn("_h2", F.xxhash64(F.lit(1), *reversed(fields), *scope))
    joined = with_first(marked)
    more = F.array_compact(F.array(
        F.when(F.col("row") > F.col("_first"), "identical_records"),
        F.when(F.col("host") == UNKNOWN, "missing_host"),
        F.when(F.col("process") == UNKNOWN, "missing_process"),
    ))
    return joined.withColumn("flags", F.concat("flags", more)).drop("_h1", "_h2", "_first")


def enrich(events: DataFrame, catalog: Catalog = DEFAULT) -> DataFrame:
    """Add category, template and network to events."""
    out = events.withColumn("category", classify(F.col("process"), F.col("message"), catalog.categories, catalog.other)).withColumn("template", message_template(F.col("message")))
    return with_endpoints(out)
