"""Counts in fixed windows, baselines of the windows before, and the windows worth a look.

Events are counted once, by host, process and window; all else here works on the counts. ``scope`` names
columns within which hosts are told apart (none: one history over the whole data set).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.functions.text import UNKNOWN
from tidelog.operators.places import AT, counted
from tidelog.schema import LEAST_BASELINE, LOOKBACK, MOST_INCIDENTS, Params


def bucket_of(ts: Column, seconds: int) -> Column:
    """First second of the window that an instant falls in, counted from the epoch."""
    return (F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)) * seconds).cast("long")


def usable(events: DataFrame) -> DataFrame:
    """Events with a time and a known host."""
    return events.filter(F.col("timestamp").isNotNull() & F.col("host_key").isNotNull())


def process_counts(events: DataFrame, seconds: int, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, host_key, process, bucket, count, first): events of each process in each window, first by time and place."""
    rows = usable(events).select(*dict.fromkeys((*scope, "host_key", "process", *AT)), bucket_of(F.col("timestamp"), seconds).alias("bucket"))
    return counted(rows, [*scope, "host_key", "process", "bucket"])


def host_counts(counts: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, host_key, bucket, count) from the process counts."""
    return counts.groupBy(*scope, "host_key", "bucket").agg(F.sum("count").alias("count"))


def median(sorted_values: Column) -> Column:
    """Median of a sorted array of numbers as double; 0 for an empty one."""
    n = F.size(sorted_values)
    middle = F.floor((n - 1) / 2).cast("int")
    upper = F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(sorted_values, middle) + F.get(sorted_values, upper)) / 2.0).otherwise(F.lit(0.0))


def with_baseline(counts: DataFrame, keys: list[str], begin: Column, params: Params) -> DataFrame:
    """Add baseline, baseline_windows, median, mad, cutoff, ratio, detected and flagged to window counts.

    The up to 12 windows before count, back to the window ``begin``; windows without events count as zero. They
    are never made as rows: the events' windows in range are collected and padded with zeros.
    """
    s = params.seconds
    if not params.use_history:
        none = lambda kind: F.lit(None).cast(kind)
        return counts.select("*", none("double").alias("baseline"), F.lit(0).alias("baseline_windows"), none("double").alias("median"), none("double").alias("mad"), F.lit(params.min_events).cast("long").alias("cutoff"), none("double").alias("ratio"), F.lit(False).alias("detected"), (F.col("count") >= params.min_events).alias("flagged"))
    before = Window.partitionBy(*keys).orderBy("bucket").rangeBetween(-LOOKBACK * s, -s)
    n = F.least(F.lit(LOOKBACK), F.floor((F.col("bucket") - begin) / s)).cast("int")
    seen = F.collect_list("count").over(before)
    out = counts.withColumn("baseline_windows", n).withColumn("_seen", seen)
    out = out.withColumn("_all", F.array_sort(F.concat("_seen", F.array_repeat(F.lit(0).cast("long"), F.col("baseline_windows") - F.size("_seen")))))
    total = F.aggregate("_all", F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn("_mean", F.when(F.col("baseline_windows") > 0, total / F.col("baseline_windows")).otherwise(F.lit(0.0)))
    out = out.withColumn("median", median(F.col("_all")))
    out = out.withColumn("mad", median(F.array_sort(F.transform("_all", lambda x: F.abs(x - F.col("median"))))))
    robust = F.floor(F.col("median") + F.lit(3 * 1.4826) * F.col("mad")) + 1
    out = out.withColumn("cutoff", F.greatest(F.lit(params.min_events).cast("long"), F.ceil(F.col("_mean") * params.threshold).cast("long"), robust.cast("long")))
    detected = (F.col("baseline_windows") >= LEAST_BASELINE) & (F.col("count") >= F.col("cutoff")) & (F.col("count") > F.col("_mean"))
    return out.select(
        *counts.columns, F.bround("_mean", 3).alias("baseline"), "baseline_windows", "median", "mad", "cutoff",
        F.when(F.col("_mean") > 0, F.bround(F.col("count") / F.col("_mean"), 2)).alias("ratio"), detected.alias("detected"), detected.alias("flagged"),
    )


def host_baselines(hosts: DataFrame, params: Params, scope: tuple[str, ...] = ()) -> DataFrame:
    keys = [*scope, "host_key"]
    begin = F.min("bucket").over(Window.partitionBy(*keys))
    return with_baseline(hosts.withColumn("begin", begin), keys, F.col("begin"), params)


def process_baselines(counts: DataFrame, params: Params, scope: tuple[str, ...] = ()) -> DataFrame:
    """Baselines of processes; their history begins with the host's. An unknown process is never a spike."""
    begin = F.min("bucket").over(Window.partitionBy(*scope, "host_key"))
    out = with_baseline(counts.withColumn("begin", begin), [*scope, "host_key", "process"], F.col("begin"), params)
    known = F.col("process") != UNKNOWN
    return out.withColumn("detected", F.col("detected") & known).withColumn("flagged", F.col("flagged") & known)


def contributors(processes: DataFrame, hosts: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Process windows with their share of the host's window and their rank there: by count, then first seen."""
    keys = [*scope, "host_key", "bucket"]
    total = hosts.select(*keys, F.col("count").alias("host_count"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), "first"))
    return processes.join(total, keys).withColumn("percent", F.bround(100 * F.col("count") / F.col("host_count"), 2)).withColumn("rank", rank)


def kind(use_history: bool, host_detected: Column, process_detected: Column, flagged: Column) -> Column:
    if not use_history:
        return F.when(flagged, "soglia assoluta raggiunta (storico escluso)").otherwise("finestra sotto soglia (storico escluso)")
    return F.when(host_detected, "spike host").when(process_detected, "spike processo").otherwise("finestra da esaminare; spike non dimostrato")


def candidates(events: DataFrame, params: Params, scope: tuple[str, ...] = ()) -> DataFrame:
    """All flagged windows, and of hosts without one the fullest window (the earliest of equal ones)."""
    counts = process_counts(events, params.seconds, scope)
    hosts = host_baselines(host_counts(counts, scope), params, scope)
    keys = [*scope, "host_key", "bucket"]
    of_processes = process_baselines(counts, params, scope).groupBy(*keys).agg(F.bool_or("detected").alias("process_detected"), F.bool_or("flagged").alias("process_flagged"))
    windows = hosts.join(of_processes, keys).withColumn("host_flagged", F.col("flagged")).withColumn("flagged", F.col("flagged") | F.col("process_flagged"))
    host = Window.partitionBy(*scope, "host_key")
    peak = F.row_number().over(host.orderBy(F.desc("count"), "bucket")) == 1
    return (
        windows.withColumn("_any", F.bool_or("flagged").over(host)).withColumn("_peak", peak)
        .filter(F.col("flagged") | (~F.col("_any") & F.col("_peak"))).drop("_any", "_peak")
        .withColumn("kind", kind(params.use_history, F.col("detected"), F.col("process_detected"), F.col("flagged")))
    )


def ranking() -> list[Column]:
    return [F.desc("flagged"), F.desc(F.col("count") - F.coalesce("baseline", F.lit(0.0))), F.desc("count"), F.asc("host_key"), F.asc("bucket")]


def top_incidents(found: DataFrame, limit: int = MOST_INCIDENTS, scope: tuple[str, ...] = ()) -> DataFrame:
    """The first candidates, of each scope: flagged ones first, then by excess over the baseline, count, host and time."""
    if scope:
        rank = F.row_number().over(Window.partitionBy(*scope).orderBy(*ranking()))
        return found.withColumn("_r", rank).filter(F.col("_r") <= limit).drop("_r").withColumn("incident_id", incident_id())
    return found.orderBy(*ranking()).limit(limit).withColumn("incident_id", incident_id())


def small(df: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """A broadcast of a table whose size is a limit of the report; under a scope it grows with the scopes, and Spark decides."""
    return df if scope else F.broadcast(df)


def incident_id() -> Column:
    """The id of a host's window. Under a scope, windows are told apart by scope and id."""
    return F.substring(F.sha2(F.concat_ws("|", "host_key", F.col("bucket").cast("string")), 256), 1, 16)


def window_totals(found: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each scope: candidate, flagged and detected windows."""
    detected = F.col("detected") | F.col("process_detected")
    return found.groupBy(*scope).agg(F.count(F.lit(1)).alias("incident_count"), F.count_if("flagged").alias("flagged_count"), F.count_if(detected).alias("spike_count"))
