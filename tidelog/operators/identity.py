"""Rows whose hash stands in several rows, told without a shuffle of those that stand alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.shared import cut

#: A hash that makes up this share of the repeated rows goes to them by broadcast: there are at most 1 / share of these.
HOT_SHARE = 1 / 10_000
#: Bits of one bitmap (fixed by Spark's bitmap functions), and bitmaps of a filter at most: 32 MB in all.
_BITS, MOST_BITMAPS = 1 << 15, 1 << 13
_BITS_OF_A_HASH = 16


def _places(bitmaps: int) -> tuple[Column, Column, Column]:
    """The bitmap of a row's hash, and its two bits there."""
    return F.pmod("_h1", F.lit(bitmaps)), F.pmod(F.shiftright("_h1", 24), F.lit(_BITS)), F.pmod("_h2", F.lit(_BITS))


def bloom(hashes: DataFrame, bitmaps: int) -> DataFrame:
    """(bitmap, bits): the Bloom filter of (_h1, _h2), in which each hash sets two bits of one bitmap."""
    bitmap, *bits = _places(bitmaps)
    set_ = hashes.select(bitmap.alias("_bitmap"), F.explode(F.array(*bits)).alias("bit"))
    return set_.groupBy("_bitmap").agg(F.bitmap_construct_agg("bit").alias("_bits"))


def maybe(bitmaps: int) -> Column:
    """Whether the bits of a row's hash are set in ``_bits``; false without such a bitmap."""
    of_byte = lambda bit: F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = lambda bit: F.getbit(of_byte(bit), (bit % 8).cast("int")) == 1
    _, one, two = _places(bitmaps)
    return F.coalesce(is_set(one) & is_set(two), F.lit(False))


def with_first(rows: DataFrame, order: str = "row") -> DataFrame:
    """Add ``_first``, the least ``order`` of the rows with the same (_h1, _h2), where there are several; else null.

    A grouped count tells the repeated hashes, which are kept as a table. Those that make up much of the rows are
    joined by broadcast; the other repeated rows pass a broadcast Bloom filter of bounded size and are joined by
    hash. Rows that stand alone are not shuffled but for the filter's false positives (some 1.4 %), of which there are
    more, with the same result, once there are more hashes than the filter has room for. ``rows`` are read three
    times and should be a stored table.
    """
    twice = cut(rows.groupBy("_h1", "_h2").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    hashes, of_rows = twice.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if not hashes:
        return rows.withColumn("_first", F.lit(None).cast(rows.schema[order].dataType))
    hot = F.col("_n") >= of_rows * HOT_SHARE
    out = rows.join(F.broadcast(twice.filter(hot).drop("_n")), ["_h1", "_h2"], "left")
    bitmaps = max(1, min(MOST_BITMAPS, -(-hashes * _BITS_OF_A_HASH // _BITS)))
    rest = twice.filter(~hot).drop("_n")
    out = out.withColumn("_bitmap", _places(bitmaps)[0]).join(F.broadcast(bloom(rest, bitmaps)), "_bitmap", "left").withColumn("_maybe", F.col("_first").isNull() & maybe(bitmaps)).drop("_bitmap", "_bits")
    joined = out.filter("_maybe").drop("_first").join(rest, ["_h1", "_h2"], "left")
    return out.filter("not _maybe").unionByName(joined).drop("_maybe")
