"""Stored events: written once by day, read again by the windows and views that need a part of them.

A day is a folder, so that a question about some windows reads their days alone. Within a day, events are sorted by host
and time: the statistics of a row group then tell which hosts and times it holds, and Bloom filters which processes, and
pushed-down filters leave out the groups that can't hold an answer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.windows import small
from tidelog.schema import LOOKBACK, Params

#: Bytes of a row group; smaller ones let filters leave out more.
GROUP_BYTES = 16 << 20
#: The folder of events without a time.
UNTIMED = "none"


def day_of(timestamp: Column) -> Column:
    return F.coalesce(F.date_format(timestamp, "yyyy-MM-dd"), F.lit(UNTIMED))


def write_events(events: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Events as Parquet, a folder for each day; a day's events are dealt to many tasks by ranges of host and time."""
    rows = events.withColumn("day", day_of(F.col("timestamp"))).repartitionByRange("day", "host_key", "timestamp", "source", "row").sortWithinPartitions("day", "host_key", "timestamp")
    options = {"parquet.block.size": GROUP_BYTES, "parquet.bloom.filter.enabled#process": "true", "parquet.bloom.filter.expected.ndv#process": "10000"}
    rows.write.mode(mode).options(**options).partitionBy("day").parquet(folder)


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """All stored events, with their day as text."""
    fields = [T.StructField("day", T.StringType()) if f.name == "day" else f for f in spark.read.parquet(folder).schema]
    return spark.read.schema(T.StructType(fields)).parquet(folder)


def window_days(top: DataFrame, params: Params, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, host_key, day): the days of the reported windows and, with history, of the windows before that they are compared with."""
    begin = F.col("bucket") - (LOOKBACK * params.seconds if params.use_history else 0)
    days = F.sequence(F.to_date(F.timestamp_seconds(begin)), F.to_date(F.timestamp_seconds(F.col("bucket") + params.seconds - 1)))
    return top.select(*scope, "host_key", F.explode(days).alias("d")).select(*scope, "host_key", F.date_format("d", "yyyy-MM-dd").alias("day")).distinct()


def around_windows(stored: DataFrame, top: DataFrame, params: Params, scope: tuple[str, ...] = ()) -> DataFrame:
    """The stored events of the reported windows' hosts and days, for ``incidents.incident_events`` and ``previous_categories``.

    Without a scope the windows are few: their days and hosts are named in the filter, and other folders aren't read. Under a
    scope a join on day and host leaves Spark to prune the days when it knows them.
    """
    days = window_days(top, params, scope)
    if not scope:
        found = days.collect()  # two days for each of MOST_INCIDENTS windows, where a window is shorter than a day
        stored = stored.filter(F.col("day").isin(sorted({r["day"] for r in found})) & F.col("host_key").isin(sorted({r["host_key"] for r in found})))
    return stored.join(small(days, scope), [*scope, "host_key", "day"], "left_semi")


def view(stored: DataFrame, host: str | None = None, levels: tuple[str, ...] = (), process: str | None = None, process_contains: str | None = None, contains: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """The stored events that all given filters keep.

    host, levels (severities) and process are equal to the value; the two ``contains`` look in any case for a text in the
    process, and in host, process and message. since and until (exclusive) are UTC times, ``2024-01-31 12:00:00``, and name days too.
    """
    kept = []
    if host is not None:
        kept.append(F.col("host_key") == host)
    if levels:
        kept.append(F.col("severity").isin(*levels))
    if process is not None:
        kept.append(F.col("process") == process)
    if process_contains is not None:
        kept.append(F.contains(F.lower("process"), F.lit(process_contains.lower())))
    if contains is not None:
        kept.append(F.contains(F.lower(F.concat_ws(" ", "host_key", "process", "message")), F.lit(contains.lower())))
    if since is not None:
        kept.append((F.col("timestamp") >= F.lit(since).cast("timestamp")) & (F.col("day") >= since[:10]) & (F.col("day") != UNTIMED))
    if until is not None:
        kept.append((F.col("timestamp") < F.lit(until).cast("timestamp")) & (F.col("day") <= until[:10]))
    return stored.filter(reduce(lambda a, b: a & b, kept)) if kept else stored


def incident_view(incidents: DataFrame, host: str | None = None) -> DataFrame:
    """Dossiers or ranked windows of one host; all of them without one."""
    return incidents if host is None else incidents.filter(F.col("host_key") == host)


def start_view(starts: DataFrame, contains: str = "") -> DataFrame:
    """Starts whose host, process or target holds a text, in any case."""
    return starts.filter(F.contains(F.lower(F.concat_ws(" ", "host_key", "process", "target")), F.lit(contains.lower())))


def diagnostic_view(diagnostics: DataFrame, level: str | None = None) -> DataFrame:
    """Diagnostics of one level: error, warning or info."""
    return diagnostics if level is None else diagnostics.filter(F.col("level") == level)
