"""Import diagnostics: counts and located examples of each problem, and a report of each file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.operators.issues import FIELD_NAMES, ISSUES
from tidelog.schema import MOST_EXAMPLES

_LEVELS = {"error": 0, "warning": 1, "info": 2}
FOUND = "source string, code string, stage int, row long, line_start long, line long, place int, column string, value string"


def issue_table(spark) -> DataFrame:
    return spark.createDataFrame([*ISSUES], "code string, level string, field string, title string, impact string, action string")


def row_issues(events: DataFrame) -> DataFrame:
    """Every flag and field diagnostic of every event, located: FOUND columns (stage 2: rows)."""
    field = F.lit(None).cast("string")
    for code, _, name, *_ in ISSUES:
        field = F.when(F.col("code") == code, F.lit(name)).otherwise(field)
    flags = events.select("*", F.posexplode("flags").alias("place", "code")).withColumn("field", field)
    shown = F.lit(None).cast("string")
    for name, text in FIELD_NAMES.items():
        shown = F.when(F.col("field") == name, text).otherwise(shown)
    timed = F.col("field") == "timestamp"
    column = F.coalesce(F.when(timed, F.col("timestamp_source")), F.get(F.map_values(F.map_filter("column_sources", lambda k, _: k == F.col("field"))), 0), shown, F.lit(""))
    original = F.get(F.map_values(F.map_filter("columns", lambda k, _: k == F.col("field"))), 0)
    value = F.when(timed, F.col("timestamp_original")).when(F.col("field") == "", F.col("raw")).when(F.size("columns") > 0, original)
    for name in ("host", "process", "message", "severity", "facility", "host_ip"):
        value = F.coalesce(value, F.when(F.col("field") == name, F.col(name)))
    at = ["source", "code", F.lit(2).alias("stage"), "row", "line_start", "line"]
    by_flag = flags.select(*at, "place", column.alias("column"), F.substring(F.coalesce(value, F.lit("")), 1, 240).alias("value"))
    details = events.select("*", F.posexplode("field_diagnostics").alias("place", "d")).select("source", "d.code", F.lit(2).alias("stage"), "row", "line_start", "line", (F.col("place") + 100).alias("place"), "d.column", F.substring("d.value", 1, 240).alias("value"))
    return by_flag.unionByName(details)


def diagnostics(found: DataFrame) -> DataFrame:
    """(source, code, level, field, title, impact, action, count, examples): examples are the first five found.

    ``found`` has FOUND columns: problems of the header (stage 0), of the structure (1) and of rows (2).
    """
    keys = ["source", "code"]
    counts = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("stage", "row", "place", "column", "value"))
    firsts = found.withColumn("r", rank).filter(F.col("r") <= MOST_EXAMPLES)
    example = F.struct("r", F.col("row").alias("record"), "line_start", F.col("line").alias("line_end"), "column", "value")
    examples = firsts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(example)), lambda x: x.dropFields("r")).alias("examples"))
    issues = F.broadcast(issue_table(found.sparkSession))
    return counts.join(examples, keys).join(issues, "code").select("source", "code", "level", "field", "title", "impact", "action", "count", "examples")


def level_order() -> list:
    """Diagnostics by level, then code."""
    out = F.lit(9)
    for level, n in _LEVELS.items():
        out = F.when(F.col("level") == level, n).otherwise(out)
    return [out, F.col("code")]


def import_report(report_rows: DataFrame, found: DataFrame) -> DataFrame:
    """(source, json): the report of each file with its diagnostics in order, as one JSON document."""
    place = F.struct(level_order()[0].alias("level_place"), F.col("code").alias("code_place"))
    parts = diagnostics(found).select("source", F.struct(place.alias("place"), "code", "level", "field", "title", "impact", "action", "count", "examples").alias("d"))
    parts = parts.groupBy("source").agg(F.transform(F.array_sort(F.collect_list("d"), lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0)), lambda x: x.dropFields("place")).alias("diagnostics"))
    out = report_rows.join(parts, "source", "left")
    return out.select("source", F.to_json(F.struct(*out.columns)).alias("json"))


def report(events: DataFrame, found: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each file: status, issue counts by level and code, records read, kept, skipped and usable.

    ``files``: source, records_read, skipped, truncated, blocked. A blocked file has no usable records.
    """
    levels = F.broadcast(issue_table(found.sparkSession).select("code", "level"))
    by_code = found.groupBy("source", "code").agg(F.count(F.lit(1)).alias("n")).join(levels, "code")
    sums = by_code.groupBy("source").agg(*(F.sum(F.when(F.col("level") == k, F.col("n")).otherwise(0)).alias(f"{k}s") for k in _LEVELS), F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("counts"))
    records = found.filter("row is not null").groupBy("source").agg(F.count_distinct("row").alias("records_with_issues"))
    kept = events.groupBy("source").agg(F.count(F.lit(1)).alias("parsed"), F.count("timestamp").alias("with_timestamp"), F.count_if(F.col("timestamp").isNotNull() & F.col("host_key").isNotNull()).alias("usable"))
    r = files.join(sums, "source", "left").join(records, "source", "left").join(kept, "source", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    live = lambda c: F.when(F.col("blocked"), 0).otherwise(n(c))
    status = (
        F.when(F.col("blocked"), "blocked").when((F.col("skipped") > 0) | F.col("truncated"), "partial").when(n("parsed") == 0, "empty")
        .when((n("errors") > 0) | (n("warnings") > 0), "warning").otherwise("ok")
    )
    return r.select(
        "source", status.alias("status"), n("errors").alias("errors"), n("warnings").alias("warnings"), n("infos").alias("infos"), "counts", "records_read", "skipped", "truncated",
        live("parsed").alias("analyzed_records"), F.when(F.col("blocked"), n("parsed")).otherwise(0).alias("parsed_before_block"), (~F.col("blocked") & ~F.col("truncated")).alias("complete"), *(["sha256"] if "sha256" in files.columns else []), n("records_with_issues").alias("records_with_issues"), live("with_timestamp").alias("with_timestamp"), live("usable").alias("usable_for_windows"),
    )


def timestamp_sources(events: DataFrame) -> DataFrame:
    """(source, timestamp_source, count) of events with a time."""
    return events.filter("timestamp is not null").groupBy("source", F.coalesce("timestamp_source", F.lit("syslog")).alias("timestamp_source")).agg(F.count(F.lit(1)).alias("count"))
