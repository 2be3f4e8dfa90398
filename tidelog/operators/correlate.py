"""Associations over the whole data set: values that go with a process, and processes active together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.functions.text import UNKNOWN
from tidelog.operators.places import WHERE, counted
from tidelog.operators.windows import process_counts

#: Rows of each report, and processes of a host that are compared.
MOST, MOST_PROCESSES = 20, 20
#: Windows of a span, whose sets of windows are intersected in one row.
SPAN = 1024
FIELDS = ("facility", "severity", "host_ip")


def associations(events: DataFrame, scope: tuple[str, ...] = (), limit: int = MOST) -> DataFrame:
    """(relation, host, process, value, count, process_share, rank): the commonest values of each field by process.

    The share is of all events of that host's process, whatever their value. Equal counts stand in the order
    in which they were first seen.
    """
    keys = [*scope, "host_key", "process"]
    known = events.filter(F.col("host_key").isNotNull() & (F.col("process") != UNKNOWN))
    value = F.explode(F.array(*(F.struct(F.lit(f"process_{f}").alias("relation"), F.col(f).alias("value")) for f in FIELDS)))
    base = [*dict.fromkeys((*keys, *WHERE))]
    counts = counted(known.select(*base, value.alias("p")).select(*base, "p.relation", "p.value"), [*keys, "relation", "value"], WHERE)
    # Each event has one value of a field, unknown ones too, so that the counts of a relation add up to the process.
    total = F.sum("count").over(Window.partitionBy(*keys, "relation"))
    rank = F.row_number().over(Window.partitionBy(*scope, "relation").orderBy(F.desc("count"), "first", "host_key", "process", "value"))
    shares = counts.withColumn("process_share", F.bround(100 * F.col("count") / total, 2)).filter(F.col("value") != UNKNOWN)
    return shares.withColumn("rank", rank).filter(F.col("rank") <= limit).select(*scope, "relation", F.col("host_key").alias("host"), "process", "value", "count", "process_share", "rank")


def activity_rank(events: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, host_key, process, events, activity): the 20 processes of each host with most events, then by name.

    Processes without any event at a known time are left out, but untimed events count.
    """
    keys = [*scope, "host_key", "process"]
    known = events.filter(F.col("host_key").isNotNull() & (F.col("process") != UNKNOWN))
    totals = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"), F.count("timestamp").alias("timed")).filter("timed > 0").drop("timed")
    rank = F.row_number().over(Window.partitionBy(*scope, "host_key").orderBy(F.desc("events"), "process"))
    return totals.withColumn("activity", rank).filter(F.col("activity") <= MOST_PROCESSES)


def active_windows(events: DataFrame, seconds: int, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, host_key, process, bucket): windows in which the 20 most active processes of each host have events."""
    keys = [*scope, "host_key", "process"]
    counts = process_counts(events, seconds, scope).select(*keys, "bucket")
    return counts.join(activity_rank(events, scope), keys)


def shared_windows(active: DataFrame, seconds: int, host: list[str]) -> DataFrame:
    """(host, first, second, shared_windows): pairs of a host's processes, the more active one first, with windows in common.

    A host's windows are cut into spans; in each, a process has the set of its windows, and sets are intersected: the
    20 processes of a span are one row, and no pair is made for each window.
    """
    number = F.floor(F.col("bucket") / seconds)
    sets = active.groupBy(*host, "activity", "process", F.floor(number / SPAN).alias("span")).agg(F.collect_list(F.pmod(number, F.lit(SPAN)).cast("short")).alias("at"))
    spans = sets.groupBy(*host, "span").agg(F.collect_list(F.struct("activity", "process", "at")).alias("all"))
    later = lambda x: F.filter("all", lambda y: y["activity"] > x["activity"])
    pair = lambda x, y: F.struct(x["process"].alias("first"), y["process"].alias("second"), F.size(F.array_intersect(x["at"], y["at"])).alias("n"))
    pairs = spans.select(*host, F.explode(F.flatten(F.transform("all", lambda x: F.transform(later(x), lambda y: pair(x, y))))).alias("p")).select(*host, "p.*")
    return pairs.filter("n > 0").groupBy(*host, "first", "second").agg(F.sum("n").alias("shared_windows"))


def cooccurrence(events: DataFrame, seconds: int, scope: tuple[str, ...] = (), limit: int = MOST) -> DataFrame:
    """(host, first, second, shared_windows, jaccard, rank): process pairs of a host with two shared windows or more."""
    host = [*scope, "host_key"]
    active = active_windows(events, seconds, scope)
    sizes = active.groupBy(*host, "process").agg(F.count(F.lit(1)).alias("windows"), F.max("activity").alias("activity"), F.max("events").alias("events"))
    pairs = shared_windows(active, seconds, host)
    side = lambda name: sizes.select(*host, F.col("process").alias(name), F.col("windows").alias(f"n_{name}"), F.col("activity").alias(f"r_{name}"), F.col("events").alias(f"e_{name}"))
    told = pairs.filter("shared_windows >= 2").join(side("first"), [*host, "first"]).join(side("second"), [*host, "second"])
    jaccard = F.bround(F.col("shared_windows") / (F.col("n_first") + F.col("n_second") - F.col("shared_windows")), 3)
    # Equal pairs stand by their host's most active process, host and activity.
    order = [F.desc("shared_windows"), F.desc("jaccard"), F.desc("host_events"), "host_key", "r_first", "r_second"]
    told = told.withColumn("jaccard", jaccard).join(sizes.groupBy(*host).agg(F.max("events").alias("host_events")), host)
    rank = F.row_number().over(Window.partitionBy(*scope).orderBy(*order)) if scope else None
    if rank is None:  # a top-k over all: sorted partitions are cut before they meet
        top = told.orderBy(*order).limit(limit)
        return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))).select(F.col("host_key").alias("host"), "first", "second", "shared_windows", "jaccard", "rank")
    return told.withColumn("rank", rank).filter(F.col("rank") <= limit).select(*scope, F.col("host_key").alias("host"), "first", "second", "shared_windows", "jaccard", "rank")
