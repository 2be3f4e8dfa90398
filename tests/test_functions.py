"""Row-local functions: times, lines, addresses, categories."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidelog.functions import classify as C
from tidelog.functions.network import clean_ip, with_endpoints
from tidelog.functions.syslog import normalize_facility, normalize_severity, strip_structured_data, with_parsed_line
from tidelog.functions.text import normal_header
from tidelog.functions.time import iso_utc, offset_seconds, with_timestamp
from tidelog.schema import Params


def one(spark, values, column):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[1] for r in df.select("k", column(F.col("v"))).orderBy("k").collect()]


def times(spark, values, **kw):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [(r[0], r[1]) for r in with_timestamp(df, "p", "v", as_of_year=2026, **kw).orderBy("k").select(iso_utc(F.col("p.ts")), "p.flags").collect()]


def test_timestamps(spark):
    got = times(spark, ["2026-10-05T10:15:00Z", "2026-10-05 12:15:00+02:00", "2026-10-05T10:15:00.1234567", "2026-10-05", "31/02/2026 10:00:00", "05/10/2026, 10:15 PM", "13/10/2026 10:15:30", "Oct  5 12:00:00", "soon", "", None, "n/a", "2026-10-05T10:15:00 UTC"])
    assert got == [
        ("2026-10-05T10:15:00Z", []), ("2026-10-05T10:15:00Z", []), ("2026-10-05T10:15:00.123456Z", ["assumed_timezone"]), ("2026-10-05T00:00:00Z", ["assumed_timezone"]),
        (None, ["invalid_timestamp"]), ("2026-10-05T22:15:00Z", ["ambiguous_date", "assumed_timezone"]), ("2026-10-13T10:15:30Z", ["assumed_timezone"]), ("2026-10-05T12:00:00Z", ["inferred_year", "assumed_timezone"]),
        (None, ["invalid_timestamp"]), (None, ["missing_timestamp"]), (None, ["missing_timestamp"]), (None, ["missing_timestamp"]), ("2026-10-05T10:15:00Z", []),
    ]
    assert times(spark, ["05/10/2026 10:00:00"], date_order="MDY")[0][0] == "2026-05-10T10:00:00Z"
    assert times(spark, ["2026-10-05T10:00:00"], offset="+02:00")[0][0] == "2026-10-05T08:00:00Z"
    assert times(spark, ["2026-10-05T10:00:00", "2026-10-05T10:00:00+02:00"], offset="+02:00", declared_utc=True) == [("2026-10-05T10:00:00Z", ["column_utc"]), ("2026-10-05T08:00:00Z", ["timezone_conflict"])]


def test_offsets_and_parameters():
    assert offset_seconds("-03:30") == -12600
    for bad in ("+15:00", "+14:01", "2:00", "+02:60"):
        with pytest.raises(ValueError):
            offset_seconds(bad)
    for bad in ({"window_minutes": 0}, {"window_minutes": 1441}, {"threshold": 1.0}, {"threshold": float("nan")}, {"min_events": 2}, {"date_order": "YMD"}, {"delimiter": "x"}, {"max_events": 0}, {"use_history": 1}):
        with pytest.raises(ValueError):
            Params(**bad)


def test_lines(spark):
    lines = [
        "<34>Oct  5 12:00:00 host sshd[42]: Failed password", r'<30>1 2026-10-05T12:00:00Z host app 77 - [x a="b\]"][y n="z"] message', "2026-10-05T12:00:00Z h proc[7]: hi: there",
        "proc[9]: text", "just text here", "", None, "<999>1 2026-10-05T12:00:00Z - - - - - m",
    ]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(lines)], "k int, v string")
    got = [tuple(r) for r in with_parsed_line(df, "v", as_of_year=2026).orderBy("k").select("line_.host", "line_.process", "line_.pid", "line_.severity", "line_.facility", "line_.message").collect()]
    u = "unknown"
    assert got == [
        ("host", "sshd", "42", "critical", "auth", "Failed password"), ("host", "app", "77", "info", "daemon", "message"), ("h", "proc", "7", u, u, "hi: there"),
        (u, "proc", "9", u, u, "text"), (u, u, "", u, u, "just text here"), (u, u, "", u, u, ""), (u, u, "", u, u, ""), (u, u, "", u, u, "m"),
    ]
    assert one(spark, ["- text", "-", "[a b", "plain"], strip_structured_data) == ["text", "", "", "plain"]


def test_labels_and_headers(spark):
    assert one(spark, ["3", "ERR", "panic", "8", "", None, "Custom"], normalize_severity) == ["error", "error", "emergency", "8", "unknown", "unknown", "custom"]
    assert one(spark, ["4", "23", "24", "AUTH"], normalize_facility) == ["auth", "local7", "24", "auth"]
    assert normal_header("﻿Time Generated [UTC]") == "timegenerated[utc]" and normal_header(None) == ""


def test_addresses(spark):
    got = one(spark, ["10.0.0.1", "10.0.0.256", "01.2.3.4", "[::1]", "2001:DB8:0:0:1:0:0:1", "::", "1::2::3", "1:2:3:4:5:6:7", "::ffff:1.2.3.4", "fe80:0:0:0:0:0:0:0", "", None], clean_ip)
    assert got == ["10.0.0.1", "", "", "::1", "2001:db8::1:0:0:1", "::", "", "", "::ffff:102:304", "fe80::", "", ""]


def test_categories_templates_and_endpoints(spark):
    messages = ["Failed password for root from 192.0.2.9 port 2", "apt downloading package updates", "DNS tunneling detected", "dns tunnel not detected", "SERVFAIL for x", "SRC=10.0.0.1 DST=192.0.2.1 DPT=99999", "hello"]
    assert one(spark, messages, lambda c: C.classify(F.lit("p"), c)) == ["auth_failure", "update_download", "dns_tunnel_alert", "other", "dns_error", "network_connection", "other"]
    assert one(spark, ["x 10.1.2.3  pid=77 [5]\n", " ", "id 123e4567-e89b-12d3-a456-426614174000"], C.message_template) == ["x <ip> pid=<pid> [<pid>]", "(messaggio vuoto)", "id <id>"]
    df = spark.createDataFrame([(messages[0], "auth_failure", "10.0.0.1"), (messages[5], "network_connection", "10.0.0.1"), ("src=192.0.2.1 dst=10.0.0.1 user='bob'", "other", "10.0.0.1")], "message string, category string, host_ip string")
    n = [tuple(r[0]) for r in with_endpoints(df).select("network").collect()]
    assert n == [("192.0.2.9", "", None, None, "root", "unknown"), ("10.0.0.1", "192.0.2.1", None, None, "", "outbound"), ("192.0.2.1", "10.0.0.1", None, None, "bob", "inbound")]


def test_lifecycle(spark):
    df = spark.createDataFrame([("systemd", "Started example.service.", "1"), ("app", "server started on port 1", "5"), ("app", "service failed to be started", "5"), ("unknown", "started", ""), ("init", "Starting x y", "")], "process string, message string, pid string")
    got = [r[0] and tuple(r[0]) for r in df.select(C.lifecycle(F.col("process"), F.col("message"), F.col("pid"))).collect()]
    assert got == [("example.service", "example.service", "", "avvio segnalato"), ("app", "app", "5", "avvio segnalato"), None, None, ("x y", "x", "", "avvio richiesto")]
