"""Starts of processes, what the process does next, and what else happens on the host around that time.

Starts meet events on host and bin of time, so that under a scope, where there are many, a pair is only made within reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.functions.classify import lifecycle
from tidelog.functions.text import UNKNOWN
from tidelog.operators.places import AT, counted
from tidelog.operators.windows import small, usable

#: Starts shown, seconds that follow-ups may take, follow-ups and neighbours shown, neighbours looked at.
MOST_STARTS, FOLLOW_SECONDS, MOST_FOLLOWING, MOST_NEARBY, MOST_INSPECTED = 100, 1800, 20, 10, 2000
_OBSERVED = "prima osservazione; avvio non dimostrato"


def with_lifecycle(events: DataFrame) -> DataFrame:
    return usable(events).withColumn("start", lifecycle(F.col("process"), F.col("message"), F.col("pid")))


def first_observations(events: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """The first event of each (host, process, pid), by time and place."""
    keys = [*scope, "host_key", "process", "pid"]
    out = counted(usable(events), keys)
    return out.select(*keys, *(f"first.{c}" for c in AT if c not in scope))


def starts(events: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """All starts: those that a message tells of, and first observations of processes without one.

    (scope, host_key, process, pid, timestamp, source, row, target, match_process, target_pid, status, explicit)
    """
    keys = [*scope, "host_key"]
    base = [*keys, "process", "pid", *(c for c in AT if c not in scope)]
    told = with_lifecycle(events).filter("start is not null").select(*base, "start.*", F.lit(True).alias("explicit"))
    named = told.select(*keys, F.col("match_process").alias("process"), F.col("target_pid").alias("pid")).distinct()
    seen = first_observations(events, scope).filter(F.col("process") != UNKNOWN)
    without = seen.join(named, [*keys, "process", "pid"], "left_anti").join(named.filter("pid = ''").drop("pid"), [*keys, "process"], "left_anti")
    observed = without.select(*base, F.col("process").alias("target"), F.col("process").alias("match_process"), F.col("pid").alias("target_pid"), F.lit(_OBSERVED).alias("status"), F.lit(False).alias("explicit"))
    return told.unionByName(observed)


def latest_starts(all_starts: DataFrame, scope: tuple[str, ...] = (), limit: int = MOST_STARTS) -> DataFrame:
    """The latest starts of the data set, or of each scope, numbered start_no from the earliest shown."""
    order = [*AT, F.asc("explicit")]
    back = [*map(F.desc, AT), F.asc("explicit")]
    if scope:
        shown = all_starts.withColumn("_r", F.row_number().over(Window.partitionBy(*scope).orderBy(*back))).filter(F.col("_r") <= limit).drop("_r")
    else:
        shown = all_starts.orderBy(*back).limit(limit)
    return shown.withColumn("start_no", F.row_number().over(Window.partitionBy(*(scope or (F.lit(1),))).orderBy(*order)))


def _named(shown: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    return shown.select(*(F.col(c).alias(f"s_{c}") for c in dict.fromkeys((*scope, "host_key", "process", *AT, "match_process", "target_pid", "start_no"))))


def _binned(events: DataFrame, named: DataFrame, before: int, after: int) -> tuple[DataFrame, DataFrame]:
    """Events with the bin of time that they fall in, and starts with each bin that their interval of seconds touches.

    Bins are as long as the interval's longer side, so that a start is in three of them at most, and meets each event
    of its interval in one.
    """
    width = max(before, after) * 1_000_000
    bin_of = lambda t: F.floor(t / F.lit(width)).cast("long")
    at = F.unix_micros("s_timestamp")
    return events.withColumn("bin", bin_of(F.unix_micros("timestamp"))), named.withColumn("s_bin", F.explode(F.sequence(bin_of(at - before * 1_000_000), bin_of(at + after * 1_000_000))))


def follow_ups(events: DataFrame, shown: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, start_no, source, row, rank, total): events of the started process within half an hour.

    They end before its next start, as far as that has the same pid. The starts are few; events stay where they are until only matches are left. ``total`` counts all, of which 20 are given.
    """
    e = with_lifecycle(events).select(*dict.fromkeys((*scope, "host_key", "process", "pid", *AT)), F.col("start").isNotNull().alias("starts"))
    e, s = _binned(e, _named(shown, scope), 0, FOLLOW_SECONDS)
    s = small(s, scope)
    same = [F.col(c) == F.col(f"s_{c}") for c in (*scope, "host_key", "bin")]
    after = F.struct(*AT) > F.struct(*(F.col(f"s_{c}").alias(c) for c in AT))
    soon = F.unix_micros("timestamp") <= F.unix_micros("s_timestamp") + FOLLOW_SECONDS * 1_000_000
    pid = (F.col("s_target_pid") == "") | (F.col("pid") == "") | (F.col("pid") == F.col("s_target_pid"))
    found = e.join(s, [*same, F.col("process") == F.col("s_match_process"), after, soon, pid])
    keys = [*scope, "s_start_no"]
    stop = found.filter("starts").groupBy(*keys).agg(F.min(F.struct(*AT)).alias("stop"))
    kept = found.join(small(stop, scope), keys, "left").filter(F.col("stop").isNull() | (F.struct(*AT) < F.col("stop")))
    totals = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*AT))
    top = kept.withColumn("rank", rank).filter(F.col("rank") <= MOST_FOLLOWING)
    return top.join(small(totals, scope), keys).select(*scope, F.col("s_start_no").alias("start_no"), *(["source"] if "source" not in scope else []), "row", "rank", "total")


def nearby(events: DataFrame, shown: DataFrame, seconds: int, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, start_no, source, row, delta_seconds, rank, scan_limited): the ten nearest events of other processes of the host.

    Of events as far on both sides, the earlier side comes first. At most 2,000 events are looked at for a start,
    which may leave fewer than ten; scan_limited says that the look ended there.
    """
    e, s = _binned(usable(events).select(*dict.fromkeys((*scope, "host_key", "process", *AT))), _named(shown, scope), seconds, seconds)
    s = small(s, scope)
    same = [F.col(c) == F.col(f"s_{c}") for c in (*scope, "host_key", "bin")]
    delta = F.unix_micros("timestamp") - F.unix_micros("s_timestamp")
    found = e.join(s, [*same, F.abs(delta) <= seconds * 1_000_000]).withColumn("delta", delta)
    left = F.struct(*AT) < F.struct(*(F.col(f"s_{c}").alias(c) for c in AT))
    keys = [*scope, "s_start_no"]
    place = lambda c: F.when(left, -c).otherwise(c)
    order = [F.abs("delta"), F.when(left, 0).otherwise(1), place(F.unix_micros("timestamp")), "source", place(F.col("row"))]
    looked = found.withColumn("inspected", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("inspected") <= MOST_INSPECTED)
    itself = (F.col("row") == F.col("s_row")) & (F.col("source") == F.col("s_source"))
    other = ~itself & (F.col("process") != UNKNOWN) & (F.col("process") != F.col("s_match_process")) & (F.col("process") != F.col("s_process"))
    kept = looked.filter(other).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("inspected"))).filter(F.col("rank") <= MOST_NEARBY)
    ends = looked.groupBy(*keys).agg(F.max("inspected").alias("most"))
    tenth = kept.groupBy(*keys).agg(F.max(F.when(F.col("rank") == MOST_NEARBY, F.col("inspected"))).alias("tenth"))
    limited = ends.join(tenth, keys, "left").select(*keys, (F.coalesce("tenth", "most") == MOST_INSPECTED).alias("scan_limited"))
    return kept.join(small(limited, scope), keys).select(*scope, F.col("s_start_no").alias("start_no"), *(["source"] if "source" not in scope else []), "row", F.rint(F.col("delta") / 1_000_000).cast("long").alias("delta_seconds"), "rank", "scan_limited")
