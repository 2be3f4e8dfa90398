"""Files of any size and encoding, cut into stretches at any place, against Python's sequential readers."""

from __future__ import annotations

import csv
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from tidelog.schema import Params
from tidelog.sources import readers
from tidelog.sources import records as R

P = Params(as_of_year=2026)
HEADER = "Computer,Message,Process"


@pytest.fixture
def stretched(spark):
    """Cut files into stretches of a few lines."""

    def set_to(size: str):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "12")

    yield set_to
    for name in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{name}")


def sequential(text: str, separator: str = ","):
    """(row, first and last line, cells) of the records after the header; lines end at line feeds alone."""
    out, reader, n = [], csv.reader(io.StringIO(text, newline="\n"), delimiter=separator, strict=True), 0
    start = 1
    for cells in reader:
        if cells:
            out.append((n, start, reader.line_num, cells))
            n += 1
        start = reader.line_num + 1
    return out[1:]


def records_of(spark, path, separator=","):
    table = readers.CsvFiles(spark, [path], separator)
    return table, [(r.row, r.line_start, r.line, r.value) for r in table.records([path]).orderBy("row").collect()]


def test_records_over_any_stretches(spark, tmp_path, stretched):
    r = random.Random(3)
    cell = lambda: r.choice(['plain', '"quoted, text"', '"two\nlines"', '"a ""b"" c"', '""', '', '"x\n\n""\n,"', 'it"s', '"long\n' + "line\n" * 20 + 'end"', "é"])
    text = HEADER + "\n" + "".join(f"h{k},{cell()},{cell()}\n" + "\n" * (k % 17 == 0) for k in range(150))
    (tmp_path / "cut.csv").write_text(text)
    want = sequential(text)
    for size in ("256", "64m"):
        stretched(size)
        table, got = records_of(spark, f"file:{tmp_path}/cut.csv")
        assert table.lines.rdd.getNumPartitions() > 12 or size == "64m"
        assert not table.faulty and table.scanned
        assert [(g[0], g[1], g[2]) for g in got] == [w[:3] for w in want]
        assert [next(csv.reader(io.StringIO(g[3], newline="\n"))) for g in got] == [w[3] for w in want]
    parsed = readers.cells(table.records([f"file:{tmp_path}/cut.csv"]), ",", ["a", "b", "c"]).orderBy("row").collect()
    assert [[x.a, x.b, x.c] for x in parsed] == [w[3] for w in want] and not any(x.malformed for x in parsed)


def test_files_without_line_breaks_need_no_scan(spark, tmp_path, stretched):
    (tmp_path / "plain.csv").write_text(HEADER + "\n" + "".join(f'h{k},"text, {k}",p\n' for k in range(500)))
    stretched("1k")
    table, got = records_of(spark, f"file:{tmp_path}/plain.csv")
    assert table.plain and not table.scanned and [(g[0], g[1]) for g in got] == [(k, k + 1) for k in range(1, 501)]
    plan = readers.cells(table.records([f"file:{tmp_path}/plain.csv"]), ",", ["a", "b", "c"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan


@pytest.mark.parametrize(
    ("line", "begin", "inside", "wrong"),
    [('a,b', 0, False, False), ('a,"b', 0, True, False), ('a,"b', 1, False, True), ('b",c', 1, False, False), ('"a ""b"', 0, False, False), ('"a ""b', 0, True, False), ('it"s,x', 0, False, False), ('"a"x,b', 0, False, True), ('"a" ,b', 0, False, True), ('""', 0, False, False), ('"""', 0, True, False), ('x""y', 0, False, False), ('"a"\r', 0, False, False), ('","', 1, True, False), ('', 1, True, False), ('"', 1, False, False), ('""', 1, True, False)],
)
def test_states_of_quotes(spark, line, begin, inside, wrong):
    state = spark.createDataFrame([(line,)], "value string").select(R._after(F.col("value"), ",", begin)).first()[0]
    assert (state % 4 == 1, state >= 4) == (inside, wrong)


def test_faults_of_quotes_block_a_file(spark, tmp_path):
    good = f"{HEADER}\nh,m,p\n"
    for name, text, blocked in (("open.csv", good + 'h,"m,p\n', True), ("after.csv", good + 'h,"m"x,p\n', True), ("stray.csv", good + 'h,it"s,p\nh,"m",p\n', False), ("late.csv", good + 'h,"a\nb",p\nh,"m"x,p\n', True), ("end.csv", good + 'h,"m","p"', False)):
        (tmp_path / name).write_text(text)
        events, found, files = readers.read_logs(spark, [f"file://{tmp_path}/{name}"], P)
        assert files.first().blocked == blocked and ({r.code for r in found.collect()} >= {"csv_syntax"}) == blocked, name
        try:
            n = len(sequential(text))
        except csv.Error:
            n = 0
        assert (n == 0) == blocked and events.count() == n


def test_files_of_any_size_alike(spark, tmp_path, monkeypatch, stretched):
    """The same facts, lines and events whether files are checked at once or as streams."""
    body = "h1,perché ਊĀ,p\n" + 'h2,"two\nlines",q\n' * 40 + "\n h3,x,y\n"
    names = {
        "a.csv": (f"{HEADER}\n{body}").encode(), "b.csv": (f"{HEADER}\n{body}").encode("utf-16"), "c.csv": b"\xef\xbb\xbf" + (f"\n  \n{HEADER}\n{body}h4,no,end").encode(), "d.log": "<34>Oct  5 12:00:00 host sshd[42]: perché\n\nsecond\n".encode("utf-16-be").join([b"\xfe\xff", b""]),
        "e.log": b"one\n\n\xef\xbb\xbftwo\nthree", "f.log": b"bad \xff byte\n" * 30, "g.txt": b"nul\0" * 30, "h.log": b"\n" * 60, "k b+c%20.log": b"odd name\n" * 20,
    }
    for name, raw in names.items():
        (tmp_path / name).write_bytes(raw)
    facts = lambda: sorted((tuple(r) for r in readers.file_facts(spark, [f"file://{tmp_path}/*.*"], P).collect()), key=str)

    def read():
        events, found, files = readers.read_logs(spark, [f"file://{tmp_path}/*.*"], P)
        rows = sorted((tuple(r) for r in events.select("source", "row", "line_start", "line", "host", "message", "process").collect()), key=str)
        return rows, sorted(map(str, found.collect())), sorted(map(str, files.collect()))

    (tmp_path / "wide").mkdir()
    (tmp_path / "wide/j.csv").write_text(HEADER + ",x" * 40_000 + "\n")
    cut = lambda: [len(r.first_line) for r in readers.file_facts(spark, [f"file://{tmp_path}/wide"], P).collect()]
    whole, events = facts(), read()
    assert cut() == [64 << 10]
    monkeypatch.setattr(readers, "WHOLE_BYTES", 20)
    stretched("700")
    assert facts() == whole and read() == events and cut() == [64 << 10]
    told = {r[0].rsplit("/", 1)[1]: r for r in whole}
    for name, raw in names.items():
        text = raw.decode("utf-16") if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else None
        utf8 = raw if text is None else text.encode()
        assert told[name][2:5] == (len(utf8), "utf-8" if text is None else "utf-16", hashlib.sha256(utf8).hexdigest())
    assert {n for n, r in told.items() if r[5]} == {"f.log", "g.txt"} and told["c.csv"][6] == told["a.csv"][6] == HEADER
    assert {r[0].rsplit("/", 1)[1] for r in events[0]} == {"a.csv", "b.csv", "c.csv", "d.log", "e.log", "k b+c%20.log"}
    assert [r[1:4] for r in events[0] if r[0].endswith("b.csv")] == [r[1:4] for r in events[0] if r[0].endswith("a.csv")]


def test_each_header_comes_once(spark, tmp_path, monkeypatch):
    """Many files of few headers: the driver looks at each different first line once."""
    seen = []
    plain = readers.headers
    monkeypatch.setattr(readers, "headers", lambda lines, separator="auto": seen.extend(lines) or plain(lines, separator))
    for k in range(40):
        (tmp_path / f"{k}.csv").write_text((f"{HEADER}\nh{k},m,p\n", f"Msg;Computer\nm;h{k}\n", "", "\n \n")[k % 4 if k < 8 else k % 2])
    events, _, files = readers.read_logs(spark, [f"file://{tmp_path}"], P)
    assert sorted(line for _, line in seen if line) == [HEADER, "Msg;Computer"] and sorted(r.host for r in events.collect()) == sorted(f"h{k}" for k in range(40) if k % 4 < 2 or k >= 8)
    assert files.filter("not blocked and records_read = 1").count() == 36
