"""Readers of log files: checks of each file, CSV exports with any known header, and lines of text."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.text import normal_header
from tidelog.operators.issues import FIELD_NAMES
from tidelog.operators.normalize import normalize, normalize_lines, resolve
from tidelog.operators.quality import FOUND
from tidelog.schema import ALIASES, EXPECTED, Params
from tidelog.shared import cut, stored
from tidelog.sources import records as R
from tidelog.sources.lines import FIRST_BYTES, blocks_of, numbered, raw_lines, streamed_facts, wide_lines

_BAD = "_bad_record"
SEPARATORS = (",", ";", "\t", "|")
#: Files of up to so many bytes are checked in one expression, larger ones as streams, with the same results.
WHOLE_BYTES = 64 << 20


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))


def file_facts(spark: SparkSession, paths: list[str], params: Params) -> DataFrame:
    """(source, kind, content_bytes, encoding, sha256, problem, first_line) of each .csv, .txt and .log file.

    Encoding is UTF-16 by its mark, else UTF-8; size and digest are those of the UTF-8 text. ``problem`` is the
    code that blocks the file: file_too_large, null_bytes (also for bytes that are no UTF-8), or null. first_line is the
    first line of a CSV file that isn't blank, FIRST_BYTES of it at most. Files over the limit of an import aren't read.
    """
    kinds = F.when(_suffix(F.col("path")) == "csv", "csv").when(_suffix(F.col("path")).isin("txt", "log"), "syslog")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).withColumn("kind", kinds).filter("kind is not null")
    most = params.max_file_bytes
    # UTF-16 text takes up to twice its bytes, and UTF-8 up to three halves of these.
    huge = F.col("length") > 4 * most if most else F.lit(False)
    large = ~huge & (F.col("length") > WHOLE_BYTES)
    mark = F.hex(F.substring("content", 1, 2))
    encoding = F.when(mark.isin("FFFE", "FEFF"), "utf-16").otherwise("utf-8")
    text = F.when(encoding == "utf-16", F.decode("content", "UTF-16")).otherwise(F.col("content").cast("string"))
    too_large = lambda size: size > most if most else F.lit(False)
    told = lambda size, odd: F.when(too_large(size), "file_too_large").when(odd, "null_bytes").alias("problem")
    first = lambda line: F.when(F.col("kind") == "csv", line).alias("first_line")
    small = listed.filter(~huge & ~large).select(F.col("path").alias("source"), "kind", encoding.alias("encoding"), text.alias("text"))
    size, odd = F.octet_length("text").cast("long"), ~F.is_valid_utf8("text") | (F.instr("text", "\x00") > 0)
    line = F.substring(F.regexp_extract("text", r"(?U)^﻿?(?:[^\S\n]*\n)*([^\n]*)", 1), 1, FIRST_BYTES)
    known = small.select("source", "kind", size.alias("content_bytes"), "encoding", F.sha2("text", 256).alias("sha256"), told(size, odd), first(F.when(~odd, line)))
    none = F.lit(None).cast("string")
    over = listed.filter(huge).select(F.col("path").alias("source"), "kind", F.col("length").alias("content_bytes"), none.alias("encoding"), none.alias("sha256"), F.lit("file_too_large").alias("problem"), none.alias("first_line"))
    out = known.unionByName(over)
    rest = listed.filter(large).select("path", "kind").collect()  # a row for each large file
    if not rest:
        return out
    streamed = streamed_facts(spark, [r["path"] for r in rest]).join(spark.createDataFrame([tuple(r) for r in rest], "source string, kind string"), "source")
    return out.unionByName(streamed.select("source", "kind", "content_bytes", "encoding", "sha256", told(F.col("content_bytes"), F.col("odd")), first(F.col("first_line"))))


def all_lines(spark: SparkSession, paths: list[str], wide: list[str]) -> DataFrame:
    """(source, block, id, value) of the lines of files in UTF-8 and, decoded, of the ``wide`` ones in UTF-16."""
    parts = [raw_lines(spark, paths).drop("size")] if paths else []
    parts += [wide_lines(spark, wide)] if wide else []
    return reduce(DataFrame.unionByName, parts)


def text_lines(spark: SparkSession, paths: list[str], wide: list[str] | None = None) -> DataFrame:
    """(source, row, line_start, line, value) of the lines of text files that aren't blank; only a line feed ends a line.

    Lines are numbered by their place in their stretch of the file and the lines of the stretches before it. ``wide``
    are files in UTF-16, each of which is decoded by one task as it streams through.
    """
    lines = all_lines(spark, paths, wide or [])
    out = numbered(lines, blocks_of(lines)).withColumn("row", F.col("line"))
    return out.filter(F.col("value").rlike(r"(?U)\S")).select("source", "row", F.col("row").alias("line_start"), "line", "value")


def headers(first_lines: list[tuple[str, str | None]], separator: str = "auto") -> list[tuple[str, str, list[str]]]:
    """(key, separator, columns) of the first lines of CSV files, given as (key, line).

    An unknown separator is the one by which the line has most known names.
    """
    known = {a for names in ALIASES.values() for a in names}
    out = []
    for key, line in first_lines:
        line = (line or "").lstrip("﻿").rstrip("\r")
        cells = {s: next(csv.reader([line], delimiter=s), []) for s in SEPARATORS}
        best = max(SEPARATORS, key=lambda s: sum(normal_header(x) in known for x in cells[s])) if separator == "auto" else separator
        if cells[best]:
            out.append((key, best, cells[best]))
    return sorted(out)


def header_issues(found: list[tuple[str, str, list[str]]]) -> tuple[list[tuple], set[str]]:
    """Diagnostics of the headers, as FOUND rows, and the files that they block."""
    rows, blocked = [], set()
    for source, _, columns in found:
        add = lambda code, column, value, n, source=source: rows.append((source, code, 0, None, 1, 1, n, column, value[:240]))
        names = [normal_header(c) for c in columns]
        twice = list(dict.fromkeys(n for n in names if names.count(n) > 1))
        fields = resolve(columns)
        if twice:
            add("duplicate_headers", "", ", ".join(twice), 0)
        elif not all(names):
            add("empty_header", "", "Colonna senza nome", 0)
        else:
            for k, (field, given) in enumerate(fields.items()):
                pair = field == "host" and {normal_header(c) for c in given} == {"computer", "hostname"}
                if len(given) > 1 and not pair:
                    add("ambiguous_alias", FIELD_NAMES[field], " → ".join(given), k)
            if not any(fields[f] for f in (*EXPECTED, "pid", "event_time")):
                add("unrecognized_columns", "", " | ".join(c[:60] for c in columns[:8]), 50)
            for k, field in enumerate(EXPECTED):
                if not fields[field] and not (field == "timestamp" and fields["event_time"]):
                    add("missing_column", FIELD_NAMES[field], "Colonna assente", 100 + k)
        if rows and rows[-1][0] == source and any(x[1] in ("duplicate_headers", "empty_header", "unrecognized_columns") for x in rows if x[0] == source):
            blocked.add(source)
    return rows, blocked


class CsvFiles:
    """CSV files of one separator: which of them need the scan of quotes, which hold faults, and their records.

    Files are read by as many tasks as they have stretches, those with line breaks in cells too.
    """

    def __init__(self, spark: SparkSession, sources: list[str], separator: str, wide: set[str] = frozenset()):
        self.separator = separator
        # Where stretches begin, and the ids in them, follow from how a scan is cut, which may change from one job to the next
        # (with the cores at hand, as when an executor is lost): lines are read once, and all that follows uses these.
        self.lines = stored(all_lines(spark, [s for s in sources if s not in wide], [s for s in sources if s in wide]), "lines")
        #: A row for each stretch of a file.
        self.blocks = cut(blocks_of(R.with_maps(self.lines, separator), *R.block_sums()))
        of_file = self.blocks.groupBy("source").agg(F.sum("moved").alias("moved"), F.sum("faults").alias("faults")).collect()  # a row for each file
        self.scanned = sorted(r["source"] for r in of_file if r["moved"])
        self.plain = sorted(r["source"] for r in of_file if not r["moved"])
        self.faulty = {r["source"]: None for r in of_file if r["faults"] and not r["moved"]}
        if self.scanned:
            # Records put together from lines are kept: the check and the events both read them.
            self._whole = stored(R.records(self.lines, self.blocks, [], self.scanned, separator), "records")
            bad = self._whole.filter(R.faulty(F.col("value"), separator))
            self.faulty |= {r["source"]: r["row"] for r in bad.groupBy("source").agg(F.min("row").alias("row")).collect()}

    def records(self, sources: list[str]) -> DataFrame:
        """(source, row, line_start, line, value) of the files' records after the header; blank ones don't count."""
        plain, scanned = ([s for s in part if s in set(sources)] for part in (self.plain, self.scanned))
        parts = [R.records(self.lines, self.blocks, plain, [], self.separator)] if plain else []
        parts += [self._whole.filter(F.col("source").isin(scanned))] if scanned else []
        return reduce(DataFrame.unionByName, parts)


def cells(records: DataFrame, separator: str, columns: list[str]) -> DataFrame:
    """Records of files of one header: its columns, source, row, line_start, line, malformed, width and bad.

    A record whose width isn't the header's is malformed and has no cells.
    """
    names = [f"c{k}" for k in range(len(columns))]
    options = {"sep": separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, "maxCharsPerColumn": "-1", "maxColumns": "100000", "nullValue": "\x00", "emptyValue": ""}
    out = records.withColumn("_c", F.from_csv("value", ", ".join(f"{c} string" for c in (*names, _BAD)), options))
    bad = F.col(f"_c.{_BAD}")
    bare = F.regexp_replace(bad, r'"(?:[^"]|"")*"', "")  # separators within quotes part no cells
    width = F.size(F.split(bare, "[" + separator + "]", -1))
    return out.select(*(F.coalesce(F.col(f"_c.{c}"), F.lit("")).alias(n) for c, n in zip(names, columns, strict=True)), "source", "row", "line_start", "line", bad.isNotNull().alias("malformed"), F.when(bad.isNotNull(), width).alias("width"), bad.alias("bad"))


def capped(records: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` records of each file: the limit of an import. ``row`` counts records from 1."""
    return records if limit is None else records.filter(F.col("row") <= limit)


def read_logs(spark: SparkSession, paths: list[str], params: Params = Params()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, found, files) of all CSV and text files: normalised events, FOUND diagnostics, and a row for each file.

    Files with a problem give no events. A row for each file comes to the driver, and the different first lines of CSV
    files, cut to FIRST_BYTES, each once; contents never do. Files of one header are read as one table.
    """
    facts = cut(file_facts(spark, paths, params))
    facts_ = facts.withColumn("header", F.sha2("first_line", 256))
    listed = facts_.select("source", "kind", "problem", "encoding", "header").collect()
    lines = facts_.filter("kind = 'csv' and problem is null and header is not null").groupBy("header").agg(F.first("first_line").alias("line")).collect()
    good = {k: [r for r in listed if r["kind"] == k and r["problem"] is None] for k in ("csv", "syslog")}
    wide = {r["source"] for r in listed if r["encoding"] == "utf-16"}
    rows = [(r["source"], r["problem"], 0, None, None, None, 0, "", "") for r in listed if r["problem"]]
    of_line = {key: (separator, columns) for key, separator, columns in headers([tuple(r) for r in lines], params.delimiter)}
    heads = sorted((r["source"], *of_line[r["header"]]) for r in good["csv"] if r["header"] in of_line)
    more, blocked = header_issues(heads)
    rows += more
    by_separator: dict[str, list[str]] = {}
    for source, separator, _ in heads:
        if source not in blocked:
            by_separator.setdefault(separator, []).append(source)
    tables = {separator: CsvFiles(spark, sources, separator, wide) for separator, sources in by_separator.items()}
    for table in tables.values():
        rows += [(s, "csv_syntax", 0, row, None, None, 0, "", "") for s, row in table.faulty.items()]
        blocked |= set(table.faulty)
    groups: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for source, separator, columns in heads:
        if source not in blocked:
            groups.setdefault((separator, tuple(columns)), []).append(source)
    events, bad, read = [], [], []
    for (separator, columns), sources in groups.items():
        records = cells(tables[separator].records(sources), separator, list(columns))
        read.append(records.select("source", "row", "malformed"))
        records = capped(records, params.max_events)
        code = F.when(F.col("width") > len(columns), "extra_csv_fields").otherwise("missing_csv_fields")
        value = F.format_string(f"Attese {len(columns)} colonne; trovate %d. %s", "width", F.substring("bad", 1, 160))
        bad.append(records.filter("malformed").select("source", code.alias("code"), F.lit(1).alias("stage"), "row", "line_start", "line", F.lit(0).alias("place"), F.lit("").alias("column"), F.substring(value, 1, 240).alias("value")))
        events.append(normalize(records.filter(~F.col("malformed")).drop("malformed", "width", "bad"), params))
    if good["syslog"]:
        sources = [r["source"] for r in good["syslog"]]
        lines = text_lines(spark, [x for x in sources if x not in wide], [x for x in sources if x in wide])
        read.append(lines.select("source", "row", F.lit(False).alias("malformed")))
        events.append(normalize_lines(capped(lines, params.max_events), params))
    found = reduce(DataFrame.unionByName, [spark.createDataFrame(rows, FOUND), *bad])
    empty = spark.createDataFrame([], "source string, row long, malformed boolean")
    over = F.col("row") > params.max_events if params.max_events else F.lit(False)
    counts = reduce(DataFrame.unionByName, [empty, *read]).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("malformed") & ~over).alias("skipped"), F.count_if(over).alias("over"))
    stopped = spark.createDataFrame([(s,) for s in sorted(blocked)], "source string").withColumn("stopped", F.lit(True))
    n = lambda c: F.coalesce(c, F.lit(0))
    files = (
        facts.join(counts, "source", "left").join(stopped, "source", "left")
        .select("source", "kind", "content_bytes", "encoding", "sha256", (n("n") - n("over")).alias("records_read"), n("skipped").alias("skipped"), (n("over") > 0).alias("truncated"), (F.col("problem").isNotNull() | F.col("stopped").isNotNull()).alias("blocked"))
    )
    late = files.filter("truncated").select("source", F.lit("event_limit").alias("code"), F.lit(3).alias("stage"), *(F.lit(None).cast("long").alias(c) for c in ("row", "line_start", "line")), F.lit(0).alias("place"), F.lit("").alias("column"), F.lit(f"Limite: {params.max_events} record").alias("value"))
    none = files.filter("not blocked and records_read = 0").select("source", F.lit("no_records").alias("code"), F.lit(3).alias("stage"), *(F.lit(None).cast("long").alias(c) for c in ("row", "line_start", "line")), F.lit(0).alias("place"), F.lit("").alias("column"), F.lit("File vuoto o senza record dopo l'intestazione").alias("value"))
    out = reduce(DataFrame.unionByName, events) if events else normalize_lines(spark.createDataFrame([], "source string, row long, line_start long, line long, value string"), params)
    return out, found.unionByName(late).unionByName(none), files
