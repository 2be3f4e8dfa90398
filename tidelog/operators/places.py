"""Counts of groups of events with the place of the first of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An event's place in time. Records of several files are told apart by source and row.
AT = ("timestamp", "source", "row")
#: Its place in its file.
WHERE = ("source", "row")
#: More than any row number: time and row are kept as one number, time * _ROWS + row.
_ROWS = "10000000000000000000BD"


def counted(rows: DataFrame, keys: list[str], at: tuple[str, ...] = AT) -> DataFrame:
    """(keys, count, first): the rows of each group, and the least place of one, by AT or by WHERE.

    Rows are counted by source too, with time and row in one number: a hash table can hold that, whereas all rows would
    be sorted for the least of structs. Structs are made of the counts alone.
    """
    timed = at == AT
    place = F.expr(f"cast(unix_micros(timestamp) as decimal(19, 0)) * {_ROWS} + row") if timed else F.col("row")
    counts = rows.groupBy(*dict.fromkeys((*keys, "source"))).agg(F.count(F.lit(1)).alias("count"), F.min(place).alias("_at"))
    number = F.pmod("_at", F.expr(_ROWS)).cast("long") if timed else F.col("_at")
    of_source = [F.timestamp_micros(F.expr(f"(_at - pmod(_at, {_ROWS})) div {_ROWS}")).alias("timestamp")] if timed else []
    counts = counts.withColumn("first", F.struct(*of_source, "source", number.alias("row"))).drop("_at")
    if "source" in keys:
        return counts
    return counts.groupBy(*keys).agg(F.sum("count").alias("count"), F.min("first").alias("first"))
