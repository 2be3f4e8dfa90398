"""Lines of files: read by many tasks and numbered by a scan over their stretches, or streamed in order by one.

Spark's reader cuts files at line feeds. A task's lines of a file are in order, so that a line's number is its place
there and the lines of the stretches before it. What depends on a whole file in order (its digest, a decoder's state) is
streamed: a file's lines are brought to one task, sorted by place, and taken in a batch at a time.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of a file's first line that are shown.
FIRST_BYTES = 64 << 10
_BOM = codecs.BOM_UTF8


def raw_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, size, block, id, value): lines as bytes of a string; block: where the line's stretch of the file begins; id grows along a stretch."""
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    return spark.read.option("lineSep", "\n").text(paths).select(path.alias("source"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")


def blocks_of(lines: DataFrame, *more: Column) -> DataFrame:
    """(source, block, first, lines, before, more): the stretches of each file, with the lines before each."""
    held = lines.groupBy("source", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("lines"), *more)
    before = F.sum("lines").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return held.withColumn("before", F.coalesce(before, F.lit(0)))


def numbered(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Add ``line``, the number of each line in its file from 1."""
    at = blocks.select("source", "block", (F.col("before") + 1 - F.col("first")).alias("_shift"))
    return lines.join(at, ["source", "block"]).withColumn("line", F.col("id") + F.col("_shift")).drop("_shift")


def _in_order(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, rest, value) of each file in the order of its lines, a file in one task.

    ``rest`` are the bytes that the lines leave out: 1 for a line feed at the end, 3 for a UTF-8 mark, which the reader takes off.
    """
    rows = raw_lines(spark, paths)
    rest = F.col("size") - F.sum(F.octet_length("value")) - F.count(F.lit(1)) + 1
    ends = rows.groupBy("source", "size").agg(rest.alias("rest")).select("source", "rest")
    ordered = rows.join(ends, "source").repartition("source").sortWithinPartitions("source", "block", "id")
    return ordered.select("source", "rest", F.col("value").cast("binary").alias("value"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes | None]]:
    """(source, bytes) of files in order; a file ends with None."""
    here, end = None, b""
    for batch in batches:
        sources, rests, values = (batch.column(c).to_pylist() for c in ("source", "rest", "value"))
        k = 0
        while k < len(sources):
            last = k
            while last < len(sources) and sources[last] == sources[k]:
                last += 1
            data = b"\n".join(values[k:last])
            if sources[k] == here:
                data = b"\n" + data
            else:
                if here is not None:
                    yield from ((here, end), (here, None))
                here, end = sources[k], b"\n" if rests[k] in (1, 4) else b""
                data = (_BOM if rests[k] >= 3 else b"") + data
            yield here, data
            k = last
    if here is not None:
        yield from ((here, end), (here, None))


def _is_wide(data: bytes) -> bool:
    return data[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Encoding, bytes and digest of the UTF-8 text, whether bytes are odd, and the first line of each file."""
    begun = False
    for source, data in _pieces(batches):
        if not begun:
            begun, wide, digest, size, odd, first, seen = True, _is_wide(data or b""), hashlib.sha256(), 0, False, b"", False
            decoder = codecs.getincrementaldecoder("utf-16" if wide else "utf-8")("replace" if wide else "strict")
        try:
            text = decoder.decode(data or b"", final=data is None)
        except UnicodeDecodeError:
            odd, text = True, ""
            decoder.reset()
        raw = text.encode() if wide else data or b""
        digest.update(raw)
        size += len(raw)
        odd = odd or b"\0" in raw
        if not seen:  # lines of white space aren't shown; what is kept of a line is bounded
            first += raw[: 4 * FIRST_BYTES]
            *done, first = first.split(b"\n")
            shown = next((x for x in (*done, *([first] if data is None or len(first) > FIRST_BYTES else [])) if x.decode(errors="replace").lstrip("﻿").strip()), None)
            if shown is not None:
                seen, first = True, shown[:FIRST_BYTES]
            first = first[: 4 * FIRST_BYTES]
        if data is None:
            begun = False
            line = first.decode(errors="ignore").removeprefix("﻿") if seen else None
            yield pa.RecordBatch.from_pydict({"source": pa.array([source]), "content_bytes": pa.array([size], pa.int64()), "encoding": pa.array(["utf-16" if wide else "utf-8"]), "sha256": pa.array([digest.hexdigest()]), "odd": pa.array([odd]), "first_line": pa.array([line], pa.string())})


def streamed_facts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, content_bytes, encoding, sha256, odd, first_line) of files of any size, each streamed through one task.

    odd: a NUL, or bytes that are no UTF-8. first_line: the first one that isn't blank, FIRST_BYTES of it at most.
    """
    return _in_order(spark, paths).mapInArrow(_facts, "source string, content_bytes long, encoding string, sha256 string, odd boolean, first_line string")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begun = False
    for source, data in _pieces(batches):
        if not begun:
            begun, decoder, line, rest = True, codecs.getincrementaldecoder("utf-16")("replace"), 0, ""
        *lines, rest = (rest + decoder.decode(data or b"", final=data is None)).split("\n")
        if data is None:
            begun = False
            lines += [rest] if rest else []
        yield pa.RecordBatch.from_arrays([pa.array([source] * len(lines), pa.string()), pa.array(range(line + 1, line + 1 + len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["source", "line", "value"])
        line += len(lines)


def wide_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, block, id, value) of the lines of UTF-16 files of any size, decoded as they stream through one task for each file."""
    rows = _in_order(spark, paths).mapInArrow(_decoded, "source string, line long, value string")
    return rows.select("source", F.lit(0).cast("long").alias("block"), F.col("line").alias("id"), "value")
