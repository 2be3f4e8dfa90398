"""CSV records from lines that many tasks read, where cells may hold line breaks.

Whether a line begins a record depends on the quotes of all lines before it. A line maps the state before it (outside
or inside quotes) to the state after it; such maps are composed by a scan: within each stretch of a file, then over the
stretches, which tells the state that each stretch begins with. Files in which no line leaves quotes open, and none is
blank, need no scan: each line is a record, and its number follows from its place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.sources.lines import numbered

#: States of the quotes: outside, inside, and just after a quote within, which ends the cell unless it is doubled. WRONG is added after a fault.
_OUT, _IN, _AFTER, _WRONG = 0, 1, 2, 4


def _after(value: Column, separator: str, begin: int) -> Column:
    """The state after a line; WRONG added where text follows a closing quote.

    The line's quotes are taken one by one with the text before and after each: one opens a cell only where the cell
    begins with it, and other quotes of an unquoted cell are text.
    """
    parts = F.split(F.concat(F.lit(separator), value), '"', -1)
    quotes = F.zip_with(F.slice(parts, 1, F.size(parts) - 1), F.slice(parts, 2, F.size(parts) - 1), lambda p, s: F.struct(p.alias("p"), s.alias("s")))

    def step(state: Column, x: Column) -> Column:
        old = state % 4
        new = F.when(old == _IN, _AFTER).when((old == _AFTER) & (x["p"] == ""), _IN).when(F.endswith(x["p"], F.lit(separator)), _IN).otherwise(_OUT)
        wrong = (new == _AFTER) & (x["s"] != "") & (x["s"] != "\r") & ~F.startswith(x["s"], F.lit(separator))
        return new + F.when((state >= _WRONG) | wrong, _WRONG).otherwise(0)

    return F.when(F.instr(value, '"') == 0, begin).otherwise(F.aggregate(quotes, F.lit(begin), step))


def _is_in(state: Column) -> Column:
    return state % 4 == _IN


def faulty(value: Column, separator: str) -> Column:
    """Whether a record leaves quotes open or has text after a closing quote."""
    state = _after(value, separator, _OUT)
    return _is_in(state) | (state >= _WRONG)


def blank(value: Column) -> Column:
    return value.isin("", "\r")


def with_maps(lines: DataFrame, separator: str) -> DataFrame:
    """Add to lines ``const``, the state (inside or not) that a line always ends in, ``swap``, whether it turns the state, and ``faulty`` (as a record)."""
    states = F.struct(_after(F.col("value"), separator, _OUT).alias("o"), _after(F.col("value"), separator, _IN).alias("i"))
    x = lines.withColumn("_s", states)
    out, inside = _is_in(F.col("_s.o")), _is_in(F.col("_s.i"))
    return x.withColumn("const", F.when(out == inside, out)).withColumn("swap", out & ~inside).withColumn("faulty", out | (F.col("_s.o") >= _WRONG)).drop("_s")


def block_sums() -> list[Column]:
    """For ``blocks_of`` lines with maps: lines after which a file that was outside isn't, or that are blank, and faulty ones."""
    return [F.count_if(F.coalesce("const", "swap") | blank(F.col("value"))).alias("moved"), F.count_if("faulty").alias("faults")]


def _composed(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add the composition of the maps before each row, (was_const, was_swap), and up to it, (end_const, end_swap).

    A composition is a constant or nothing, then turned or not.
    """
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    x = df.withColumn("_turns", F.sum(F.when(F.col("swap"), 1).otherwise(0)).over(upto))
    x = x.withColumn("_own", F.when(F.col("const").isNotNull(), F.struct("const", "_turns")))
    x = x.withColumn("_last", F.last("_own", ignorenulls=True).over(earlier)).withColumn("_now", F.coalesce("_own", "_last"))
    turned = lambda n, since: (n - F.coalesce(since, F.lit(0))) % 2 == 1
    was = F.col("_turns") - F.when(F.col("swap"), 1).otherwise(0)
    x = x.withColumn("was_const", F.col("_last.const")).withColumn("was_swap", turned(was, F.col("_last._turns")))
    return x.withColumn("end_const", F.col("_now.const")).withColumn("end_swap", turned(F.col("_turns"), F.col("_now._turns"))).drop("_turns", "_own", "_last", "_now")


def _state(begin: Column, const: Column, swap: Column) -> Column:
    return F.coalesce(const, begin) != swap


def _scanned(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(source, row, line_start, line, value): the records of files whose cells hold line breaks, or that have blank lines.

    Lines of a stretch are sorted and joined to records in one task; a record that goes over stretches is put together
    from its pieces.
    """
    at = ["source", "block"]
    x = _composed(numbered(lines, blocks), at, "id")
    maps = x.groupBy(*at).agg(F.max_by(F.struct("end_const", "end_swap"), "id").alias("m"))
    maps = maps.select(*at, F.when(F.col("m.end_const").isNotNull(), F.col("m.end_const") != F.col("m.end_swap")).alias("const"), (F.col("m.end_const").isNull() & F.col("m.end_swap")).alias("swap"))
    begins = _composed(maps, ["source"], "block").select(*at, _state(F.lit(False), F.col("was_const"), F.col("was_swap")).alias("_begin"))
    x = x.join(begins, at).withColumn("_in", _state(F.col("_begin"), F.col("was_const"), F.col("was_swap")))
    x = x.withColumn("record", F.max(F.when(~F.col("_in"), F.col("id"))).over(Window.partitionBy(*at).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)))
    text = lambda order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "value"))), lambda v: v["value"]), "\n")
    pieces = x.groupBy(*at, "record").agg(text("id").alias("value"), F.min("line").alias("line_start"), F.max("line").alias("line"))
    own = pieces.filter("record is not null").withColumn("_full", ~blank(F.col("value")))
    own = own.withColumn("row", F.sum(F.col("_full").cast("long")).over(Window.partitionBy(*at).orderBy("record").rowsBetween(Window.unboundedPreceding, 0)))
    sums = blocks.select(*at).join(own.groupBy(*at).agg(F.max("record").alias("last"), F.count_if("_full").alias("rows")), at, "left")
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(F.col("block").alias("b"), F.col("last").alias("r"))
    sums = sums.withColumn("_rows", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn("_from", F.last(F.when(F.col("last").isNotNull(), place), ignorenulls=True).over(before))
    own = own.filter("_full").join(sums.select(*at, "last", "_rows"), at).withColumn("row", F.col("row") + F.col("_rows"))
    columns = ["source", "row", "line_start", "line", "value"]
    open_ = own.filter("record = last").select("source", F.col("block").alias("b"), F.col("record").alias("r"), "block", "row", "line_start", "line", "value")
    rest = pieces.filter("record is null").join(sums.select(*at, "_from"), at).select("source", "_from.b", "_from.r", "block", F.lit(None).cast("long").alias("row"), "line_start", "line", "value")
    whole = open_.unionByName(rest).groupBy("source", "b", "r").agg(F.max("row").alias("row"), F.min("line_start").alias("line_start"), F.max("line").alias("line"), text("block").alias("value"))
    return own.filter("record <> last").select(*columns).unionByName(whole.select(*columns))


def _plain(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """The records of files in which each line is one."""
    x = numbered(lines, blocks)
    return x.select("source", F.col("line").alias("row"), F.col("line").alias("line_start"), "line", "value")


def records(lines: DataFrame, blocks: DataFrame, plain: list[str], scanned: list[str], separator: str) -> DataFrame:
    """(source, row, line_start, line, value): records after the header, numbered from 1 without blank ones; value is the record's text.

    ``lines``: (source, block, id, value); ``blocks``: of ``lines.blocks_of``; plain and scanned: the files without and with
    lines that move the state of the quotes or are blank.
    """
    parts = []
    if plain:
        parts.append(_plain(lines.filter(F.col("source").isin(plain)), blocks))
    if scanned:
        parts.append(_scanned(with_maps(lines.filter(F.col("source").isin(scanned)), separator), blocks.filter(F.col("source").isin(scanned))))
    out = reduce(DataFrame.unionByName, parts).filter("row > 1")
    return out.select("source", (F.col("row") - 1).alias("row"), "line_start", "line", F.regexp_replace("value", r"\r\z", "").alias("value"))
