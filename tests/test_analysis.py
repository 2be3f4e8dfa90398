"""Scenarios from files to dossiers."""

from __future__ import annotations

import hashlib
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidelog.operators import correlate, incidents, quality, summary, tree, windows
from tidelog.operators.normalize import enrich, with_identity_flags
from tidelog.plans.analysis import dossiers
from tidelog.schema import Params
from tidelog.sources import readers, sinks

HEADER = "TimeGenerated,Computer,Facility,SecurityLevel,SyslogMessage,Processname,HostIP"
START = datetime(2026, 10, 5, 10, tzinfo=timezone.utc)
P = Params(as_of_year=2026)


def row(minute, message, process="agent", host="pc-a", ip="10.0.0.1", level="info"):
    return f'{(START + timedelta(minutes=minute)).isoformat()},{host},daemon,{level},"{message}",{process},{ip}'


def burst(message, number, **kw):
    return [row(m, message, **kw) for m in (0, 5, 10)] + [row(15 + 0.01 * k, message, **kw) for k in range(number)]


@pytest.fixture
def load(spark, tmp_path):
    def run(rows, name="x.csv", header=HEADER, params=P):
        (tmp_path / name).write_text("\n".join([header, *rows] if header else rows) + "\n")
        events, found, files = readers.read_logs(spark, [f"file://{tmp_path}/{name}"], params)
        out = str(tmp_path / f"{name}.events")
        enrich(events).write.parquet(out)
        return with_identity_flags(spark.read.parquet(out)), found, files

    return run


def demo():
    quiet = [row(m, "heartbeat") for m in (0, 5, 10)] + [row(m, "routine status", "sshd", "pc-b", "10.0.0.2") for m in (0, 5, 10)]
    a = [row(15 + 0.01 * k, "connection timed out; retrying DST=192.0.2.40 DPT=443") for k in range(24)] + [row(15, "routine status") for _ in range(6)]
    b = [row(15 + 0.01 * k, "Failed password for root from 192.0.2.9 port 22", "sshd", "pc-b", "10.0.0.2") for k in range(15)]
    return [*quiet, *a, *b, row(16, "Accepted password for root from 192.0.2.9 port 22", "sshd", "pc-b", "10.0.0.2")]


def test_demo_scenario(load):
    events, found, files = load(demo())
    top = dossiers(events, P).orderBy(*windows.ranking()).collect()
    assert [(r.host_key, r["count"], r.baseline, r.baseline_windows, r.cutoff, r.ratio, r.kind) for r in top] == [("pc-a", 30, 1.0, 3, 5, 30.0, "spike host"), ("pc-b", 16, 1.0, 3, 5, 16.0, "spike host")]
    a, b = top
    assert [(s.cause, s["count"], s.percent, s.delta_pp) for s in a.suggestions] == [("retry_loop", 24, 80.0, 80.0)]
    assert [s.cause for s in b.suggestions] == ["brute_force", "credentials"] and b.suggestions[0].reason.endswith("15 fallimenti con sorgente esplicita 192.0.2.9.")
    assert b.suggestions[0].mitre_refs[0].technique == "T1110" and b.suggestions[1].mitre_refs is None
    assert [(s.src, s.user, s.failures, len(s.rows)) for s in b.sequences] == [("192.0.2.9", "root", 15, 5)]
    assert len(a.evidence) == 30 and sum(c["count"] for c in a.categories) == 30
    chart = {r.bin_start - int(START.timestamp()): r["count"] for r in summary.chart(events, 300).collect()}
    assert chart == {0: 2, 300: 2, 600: 2, 900: 46}
    d = {r.code: r["count"] for r in quality.diagnostics(found.unionByName(quality.row_issues(events))).collect()}
    assert d["identical_records"] == 5
    report = quality.report(events, found.unionByName(quality.row_issues(events)), files).first()
    assert (report.status, report.records_read, report.usable_for_windows) == ("warning", 52, 52)
    tickets = {r.ticket.split(" — ")[1]: r.ticket for r in sinks.ticket(dossiers(events, P, ("source",)), quality.report(events, found.unionByName(quality.row_issues(events)), files), P).collect()}
    told = tickets["pc-b"].split("\n")
    for line in ("- File: x.csv", "- Spike processo sshd: 16 eventi; baseline 1.0, soglia 5, 3 finestre di confronto.", "  Quota precedente 0.0%; variazione +93.75 punti percentuali.", "  Verifica: Identificare account, IP sorgente e applicazione che ripete i tentativi.", "- Evidenze mostrate 16/16; i testi oltre 2000 caratteri sono troncati.", "- Import: 52 record analizzati su 52 esaminati; 0 esclusi per struttura CSV non valida."):
        assert line in told
    assert any(t.startswith("  MITRE candidato T1110 — Brute Force") for t in told) and any("52 fallimenti" not in t and "15 fallimenti; righe [37, 38, 39, 40, 52]" in t for t in told)
    whole = quality.import_report(quality.report(events, found.unionByName(quality.row_issues(events)), files), found.unionByName(quality.row_issues(events))).first().json
    assert '"status":"warning"' in whole and '"code":"identical_records"' in whole
    starts = tree.starts(events).collect()
    assert sorted((s.host_key, s.match_process, s.explicit) for s in starts) == [("pc-a", "agent", False), ("pc-b", "sshd", False)]


def test_early_windows_and_processes(load):
    early, _, _ = load([row(0.01 * k, "x") for k in range(100)], "early.csv")
    assert [(r["count"], r.flagged, r.baseline_windows) for r in windows.candidates(early, P).collect()] == [(100, False, 0)]
    shifted = [row(m + 0.01 * k, "x", "old") for m in (0, 5, 10) for k in range(20)] + [row(m, "x", "new") for m in (0, 5, 10)] + [row(15 + 0.01 * k, "x", "old") for k in range(2)] + [row(15.5 + 0.01 * k, "x", "new") for k in range(19)]
    events, _, _ = load(shifted, "shift.csv")
    got = windows.candidates(events, P).collect()
    assert [(r["count"], r.detected, r.process_detected, r.kind) for r in got] == [(21, False, True, "spike processo")]


def test_no_history(load):
    events, _, _ = load([row(0.01 * k, "x") for k in range(10)])
    r = windows.candidates(events, Params(use_history=False)).first()
    assert (r.flagged, r.detected, r.baseline, r.cutoff) == (True, False, None, 5)


def test_sequences_keep_failures_until_three(load):
    fail, ok = "Failed password for u from 192.0.2.1 port 1", "Accepted password for u from 192.0.2.1 port 1"
    order = [fail, fail, ok, fail, ok, fail, fail, fail, ok]
    events, _, _ = load([row(0.1 * k, m, "sshd") for k, m in enumerate(order)])
    top = windows.top_incidents(windows.candidates(events, P))
    got = incidents.auth_sequences(incidents.incident_events(events, top, P)).orderBy("rank").collect()
    assert [(r.failures, list(r.rows)) for r in got] == [(3, [1, 2, 4, 5]), (3, [6, 7, 8, 9])]


def test_malformed_and_blocked_files(load):
    events, found, files = load([row(0, "a"), row(1, "b") + ",extra", "x,y", row(2, "c")], "bad.csv")
    assert sorted(r.row for r in events.collect()) == [1, 4]
    assert {r.code for r in found.collect()} == {"extra_csv_fields", "missing_csv_fields"}
    report = quality.report(events, found, files).first()
    assert (report.status, report.records_read, report.skipped) == ("partial", 4, 2)
    for name, header, rows, code in (("dup.csv", "Computer,computer,Message", ["a,b,c"], "duplicate_headers"), ("un.csv", "foo,bar", ["1,2"], "unrecognized_columns"), ("emp.csv", "Computer,,Message", ["a,b,c"], "empty_header"), ("quo.csv", HEADER, ['1,2,3,4,"open,5,6'], "csv_syntax")):
        _, found, files = load(rows, name, header)
        assert code in {r.code for r in found.collect()} and files.first().blocked
    _, _, files = load([row(k, "x") for k in range(5)], "cap.csv", params=Params(max_events=3))
    assert (files.first().truncated, files.first().records_read) == (True, 3)
    _, found, files = load(["x" * 100], "big.csv", params=Params(max_file_bytes=50))
    assert {r.code for r in found.collect()} == {"file_too_large"} and files.first().blocked


def test_delimiters_lines_and_utf16(load, spark, tmp_path):
    events, _, _ = load(["2026-10-05T10:00:00Z;h1;one; two"], "semi.csv", "TimeGenerated;Computer;Msg;Process")
    assert [(r.host, r.message) for r in events.collect()] == [("h1", "one")]
    events, _, _ = load(["<34>Oct  5 12:00:00 host sshd[42]: Failed password", "", "  ", "plain"], "x.log", None)
    assert sorted((r.row, r.host, r.category) for r in events.collect()) == [(1, "host", "auth_failure"), (4, "unknown", "other")]
    (tmp_path / "wide.csv").write_bytes(f"{HEADER}\n{row(0, 'caffè')}\n".encode("utf-16"))
    (tmp_path / "wide.log").write_bytes("<34>Oct  5 12:00:00 host sshd[42]: perché\n\nsecond\n".encode("utf-16"))
    (tmp_path / "nul.log").write_bytes(b"a\0b")
    (tmp_path / "skip.bin").write_bytes(b"a")
    facts = {r.source[-8:]: (r.encoding, r.problem) for r in readers.file_facts(spark, [f"file://{tmp_path}"], P).filter(F.col("source").rlike("wide|nul|skip")).collect()}
    assert facts == {"wide.csv": ("utf-16", None), "wide.log": ("utf-16", None), "/nul.log": ("utf-8", "null_bytes")}
    events, found, files = readers.read_logs(spark, [f"file://{tmp_path}/wide.csv", f"file://{tmp_path}/wide.log"], P)
    assert sorted((r.row, r.host, r.message) for r in events.collect()) == [(1, "host", "perché"), (1, "pc-a", "caffè"), (3, "unknown", "second")]
    assert found.count() == 0 and not any(r.blocked for r in files.collect())


def test_large_files_are_streamed(load, spark, tmp_path, monkeypatch):
    whole, _, _ = load([row(k, "x, y") for k in range(9)], "a.csv")
    monkeypatch.setattr(readers, "WHOLE_BYTES", 50)
    events, found, files = load([row(k, "x, y") for k in range(9)], "b.csv")
    assert events.count() == whole.count() == 9 and found.count() == 0 and files.first().sha256 == hashlib.sha256((tmp_path / "b.csv").read_bytes()).hexdigest()
    _, found, files = load([row(0, "x"), '1,2,"open'], "c.csv")
    assert [r.code for r in found.collect()] == ["csv_syntax"] and files.first().blocked


def test_widths_and_numbers(load, spark, tmp_path):
    _, found, _ = load(['one,"a, b, c"', 'x,"two\nlines",z', "1,2,3,4"], "w.csv", "Computer,Message,Process")
    got = sorted((r.row, r.line_start, r.line, r.code, r.value.split(".")[0]) for r in found.collect() if r.stage == 1)
    assert got == [(1, 2, 2, "missing_csv_fields", "Attese 3 colonne; trovate 2"), (3, 5, 5, "extra_csv_fields", "Attese 3 colonne; trovate 4")]
    (tmp_path / "many.log").write_text("".join(f"line {k}\n" for k in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = readers.text_lines(spark, [f"file://{tmp_path}/many.log"])
        assert lines.rdd.getNumPartitions() > 4 and lines.filter("value <> concat('line ', row)").count() == 0 and lines.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_two_files_give_what_each_gives_alone(load, spark, tmp_path):
    """Files with the same hosts and times, under the scope of their source, and the figures of both together."""
    both = [demo(), [*demo(), row(15.2, "connection timed out; retrying DST=192.0.2.41 DPT=443")]]
    alone = []
    for k, rows in enumerate(both):
        events, _, _ = load(rows, f"f{k}.csv")
        alone.append(events)
    together = alone[0].unionByName(alone[1])
    plain = lambda r: {k: v for k, v in r.asDict(True).items() if k != "source"}
    tidy = lambda d: {**d, "evidence": [{k: v for k, v in e.items() if k != "source"} for e in d["evidence"]]}
    for k, events in enumerate(alone):
        source = events.first().source
        want = sorted((tidy(plain(r)) for r in dossiers(events, P).collect()), key=lambda d: d["incident_id"])
        got = sorted((tidy(plain(r)) for r in dossiers(together, P, ("source",)).filter(F.col("source") == source).collect()), key=lambda d: d["incident_id"])
        assert got == want and all(s["checks"] for d in got for s in d["suggestions"])
        assert sorted(map(str, summary.chart(events, 300).collect())) == sorted(map(str, summary.chart(together, 300, ("source",)).filter(F.col("source") == source).drop("source").collect()))
        assert sorted(map(str, summary.distribution(events, "category").collect())) == sorted(map(str, summary.distribution(together, "category", scope=("source",)).filter(F.col("source") == source).drop("source").collect()))
    one = dossiers(together, P).filter("host_key = 'pc-a'").first()
    assert one["count"] == 61 and len(one.evidence) == 30 and len({(e.source, e.row) for e in one.evidence}) == 30


def test_missing_identity_and_sparse_dates(load):
    events, _, _ = load([row(0, "x", host="", ip=""), row(60 * 24 * 3650, "x", host="", ip="")])
    assert windows.candidates(events, P).count() == 0 and tree.starts(events).count() == 0
    bins = summary.chart(events, 300).collect()
    assert len(bins) <= 600 and sum(r["count"] for r in bins) == 2


def test_tree(load):
    events, _, _ = load([row(0, "Started example.service.", "systemd[1]"), row(1, "working", "example.service[42]"), row(2, "other", "cron"), row(3, "server started", "example.service[42]"), row(4, "late", "example.service[42]")])
    shown = tree.latest_starts(tree.starts(events))
    follow = tree.follow_ups(events, shown).join(shown.select("start_no", "target"), "start_no").filter("target = 'example.service'").collect()
    assert [(r.row, r.total) for r in follow if r.row == 2] == [(2, 1)]
    near = tree.nearby(events, shown, 300).join(shown.filter("explicit and row = 1").select("start_no"), "start_no").orderBy("rank").collect()
    assert [(r.row, r.delta_seconds) for r in near] == [(3, 120)]


def test_cooccurrence_is_of_one_host(load):
    events, _, _ = load([row(m, "x", p, h) for m in (0, 5) for p, h in (("p", "a"), ("q", "b"))])
    assert correlate.cooccurrence(events, 300).count() == 0
    events, _, _ = load([row(m, "x", p) for m in (0, 5) for p in ("p", "q")], "same.csv")
    assert [(r["first"], r["second"], r.shared_windows, r.jaccard) for r in correlate.cooccurrence(events, 300).collect()] == [("p", "q", 2, 1.0)]


def test_results_do_not_depend_on_partitions(load):
    events, _, _ = load(demo())
    a = sorted(map(str, windows.candidates(events, P).collect()))
    assert a == sorted(map(str, windows.candidates(events.repartition(7), P).collect()))


def test_csv_export_loses_no_rows_to_the_limits(spark, monkeypatch):
    """More events in a partition than an import reads of a file, and more bytes than it takes."""
    from tidelog.plans import queries

    data = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{data}/events.parquet").count()
    for limit in ({"max_events": 300}, {"max_file_bytes": 50_000}):
        monkeypatch.setattr(queries, "_TABLES", {})
        monkeypatch.setattr(queries, "PARAMS", replace(queries.PARAMS, **limit))
        assert queries.csv_export(spark, data).agg(F.sum("n")).first()[0] == rows
