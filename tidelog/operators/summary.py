"""Totals, distributions and the time chart of a whole data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.catalog import DEFAULT, Catalog
from tidelog.functions.text import UNKNOWN
from tidelog.operators.incidents import label
from tidelog.operators.places import WHERE, counted
from tidelog.operators.windows import bucket_of, small

MOST_BINS = 600


def totals(events: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each scope: total, process_count, parsed, with_timestamp."""
    known = F.col("process") != UNKNOWN
    return events.groupBy(*scope).agg(F.count(F.lit(1)).alias("total"), F.count_distinct(F.when(known, F.col("process"))).alias("process_count"), F.count_if(known).alias("parsed"), F.count("timestamp").alias("with_timestamp"))


def _first(counts: DataFrame, limit: int | None, scope: tuple[str, ...], order: list) -> DataFrame:
    if limit is None:
        return counts
    if not scope:
        return counts.orderBy(*order).limit(limit)
    return counts.withColumn("_r", F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).filter(F.col("_r") <= limit).drop("_r")


def distribution(events: DataFrame, column: str, limit: int | None = None, skip: tuple[str, ...] = (), scope: tuple[str, ...] = (), catalog: Catalog = DEFAULT) -> DataFrame:
    """(scope, name, label, count, percent): the values of a column by count, then by first record; shares of all events.

    Null values and those of ``skip`` don't count.
    """
    name = F.col(column)
    kept = name.isNotNull() & ~name.isin(*skip) if skip else name.isNotNull()
    counts = counted(events.select(*dict.fromkeys((*scope, *WHERE)), name.alias("name"), kept.alias("_kept")), [*scope, "name", "_kept"], WHERE)
    total = counts.groupBy(*scope).agg(F.sum("count").alias("total"))
    top = _first(counts.filter("_kept"), limit, scope, [F.desc("count"), "first"])
    top = top.join(total, [*scope]) if scope else top.crossJoin(F.broadcast(total))
    return top.select(*scope, "name", (label(F.col("name"), catalog) if column == "category" else F.col("name")).alias("label"), "count", F.bround(100 * F.col("count") / F.col("total"), 2).alias("percent"))


def process_messages(events: DataFrame, processes: int = 30, messages: int = 5, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, process, count, percent, message, message_count, message_rank) of the commonest processes and their templates."""
    top = distribution(events, "process", processes, scope=scope).select(*scope, F.col("name").alias("process"), "count", "percent")
    keys = [*scope, "process"]
    rows = events.join(small(top.select(*keys), scope), keys).select(*dict.fromkeys((*keys, *WHERE)), F.col("template").alias("message"))
    counts = counted(rows, [*keys, "message"], WHERE).withColumnRenamed("count", "message_count")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("message_count"), "first"))
    return counts.withColumn("message_rank", rank).filter(F.col("message_rank") <= messages).join(small(top, scope), keys).select(*keys, "count", "percent", "message", "message_count", "message_rank")


def chart(events: DataFrame, seconds: int, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, bin_start, bin_seconds, count): events in at most 600 even bins of whole windows, empty ones too."""
    counts = events.filter("timestamp is not null").groupBy(*scope, bucket_of(F.col("timestamp"), seconds).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    width = F.lit(seconds) * F.greatest(F.lit(1), F.ceil(((F.col("high") - F.col("low")) / seconds + 1) / MOST_BINS))
    span = counts.groupBy(*scope).agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).filter("low is not null").withColumn("bin_seconds", width.cast("long"))
    keys = [*scope, "bin"]
    bins = span.select(*scope, "low", "bin_seconds", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("high") - F.col("low")) / F.col("bin_seconds")))).alias("bin"))
    filled = counts.join(span, [*scope]) if scope else counts.crossJoin(F.broadcast(span))
    filled = filled.groupBy(*scope, F.floor((F.col("bucket") - F.col("low")) / F.col("bin_seconds")).alias("bin")).agg(F.sum("n").alias("count"))
    return bins.join(filled, keys, "left").select(*scope, (F.col("low") + F.col("bin") * F.col("bin_seconds")).alias("bin_start"), "bin_seconds", F.coalesce("count", F.lit(0)).alias("count"))


def hot_bins(bins: DataFrame, incidents: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """The chart with ``hot``: whether a flagged incident starts within a bin."""
    starts = incidents.filter("flagged").select(*(F.col(c).alias(f"_{c}") for c in scope), F.col("bucket").alias("_start")).distinct()
    inside = (F.col("_start") >= F.col("bin_start")) & (F.col("_start") < F.col("bin_start") + F.col("bin_seconds"))
    keys = [*scope, "bin_start"]
    # A chart has 600 bins at most, and is the side to be broadcast.
    hot = small(bins, scope).join(starts, [*(F.col(c) == F.col(f"_{c}") for c in scope), inside]).select(*keys).distinct().withColumn("hot", F.lit(True))
    return bins.join(hot, keys, "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
