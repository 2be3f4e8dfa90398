"""Steps that split hot keys, against their plain forms: logins in stretches, starts in bins, stored events by day."""

from __future__ import annotations

import random
import re
import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import REPO
from tidelog.operators import correlate, identity, incidents, tree, windows
from tidelog.operators.normalize import with_identity_flags
from tidelog.operators.places import AT, WHERE, counted
from tidelog.schema import Params
from tidelog.sources import store

START = datetime(2026, 10, 5, 10)
P = Params(as_of_year=2026)


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def plain_sequences(logins):
    """(failures, begin, end, rows) of each key's sequences, one login after the other."""
    out = []
    for key in sorted({x[:2] for x in logins}):
        held = []
        for _, _, at, row, ok in sorted((x for x in logins if x[:2] == key), key=lambda x: x[2:4]):
            if not ok:
                held.append((at, row))
            elif len(held) >= 3:
                out.append((at, row, key, len(held), held[0][0], [r for _, r in held[:4]] + [row]))
                held = []
    return [x[2:] for x in sorted(out)[:10]]


@pytest.mark.parametrize(("share", "seed"), [(0.1, 1), (0.35, 2), (0.5, 3), (0.97, 4), (0.02, 5)])
def test_sequences_over_many_stretches(spark, many_parts, share, seed):
    r = random.Random(seed)
    logins = [("a" if r.random() < 0.8 else "b", "u", r.randrange(120), k, r.random() < share) for k in range(400)]
    rows = [("i", START + timedelta(seconds=at), "f", row, "auth_success" if ok else "auth_failure", (src, user)) for src, user, at, row, ok in logins]
    df = spark.createDataFrame(rows, "incident_id string, timestamp timestamp, source string, row long, category string, network struct<src:string,user:string>")
    stretches = incidents._stretches(df.select("incident_id", F.col("network.src").alias("src"), F.col("network.user").alias("user"), "timestamp", F.col("source").alias("_file"), "row", (F.col("category") == "auth_success").alias("ok")), ["incident_id", "src", "user"])
    assert stretches.filter("src = 'a'").count() > 3
    got = incidents.auth_sequences(df).orderBy("rank").collect()
    want = plain_sequences(logins)
    assert [((g.src, g.user), g.failures, (g.begin - START).seconds, list(g.rows)) for g in got] == [tuple(w) for w in want] and (want or share > 0.9 or share < 0.05)


def test_starts_at_the_edges_of_bins(spark):
    """Bins are counted from the epoch; intervals that begin or end at an edge, and events just outside."""
    begin = datetime(2026, 10, 5, 9, 30)
    rows = [("h", "systemd", "", begin + timedelta(seconds=s), "f", k, "Started app.service.", "h") for k, s in enumerate((0, 1799, 1800, 5000))]
    rows += [("h", "app.service", "1", begin + timedelta(seconds=s), "f", 100 + k, "x", "h") for k, s in enumerate((-301, -300, 1, 299, 300, 301, 1799, 1800, 1801, 2100, 3598, 3599, 3600, 3601, 6800, 6801))]
    rows += [("h", "other", "", begin + timedelta(seconds=s), "f", 200 + k, "y", "h") for k, s in enumerate((-300, -301, 0, 300, 301, 1500, 2100, 2101))]
    events = spark.createDataFrame(rows, "host string, process string, pid string, timestamp timestamp, source string, row long, message string, host_key string")
    shown = tree.latest_starts(tree.starts(events).filter("explicit"))
    for scope in ((), ("source",)):
        numbered = {x.start_no: x for x in tree.latest_starts(tree.starts(events, scope).filter("explicit"), scope).collect()}
        follow = {(x.start_no, x.row) for x in tree.follow_ups(events, shown, scope).collect()}
        near = {(x.start_no, x.row) for x in tree.nearby(events, shown, 300, scope).collect()}
        for no, s in numbered.items():
            after = {r[5] for r in rows if r[1] == "app.service" and (s.timestamp, s.row) < (r[3], r[5]) and r[3] <= s.timestamp + timedelta(seconds=1800)}
            assert {row for n, row in follow if n == no} == after and after
            around = {r[5] for r in rows if r[1] not in ("app.service", "systemd") and abs((r[3] - s.timestamp).total_seconds()) <= 300}
            assert {row for n, row in near if n == no} == around


def test_stored_events_are_pruned(spark, tmp_path):
    """Questions about some windows and views read their days alone, and push their filters to the files."""
    rows = [(START + timedelta(hours=7 * k), f"h{k % 3}", "sshd" if k % 5 else "cron", "info", "m", "f", k, None if k % 9 == 8 else f"h{k % 3}", "other") for k in range(60)] + [(None, "h1", "sshd", "info", "m", "f", 99, "h1", "other")]
    events = spark.createDataFrame(rows, "timestamp timestamp, host string, process string, severity string, message string, source string, row long, host_key string, category string")
    store.write_events(events, f"file://{tmp_path}/events")
    stored = store.read_events(spark, f"file://{tmp_path}/events")
    assert sorted(r.row for r in stored.collect()) == sorted(r[6] for r in rows) and stored.filter("day = 'none'").count() == 1
    top = windows.top_incidents(windows.candidates(stored, P)).filter("host_key = 'h1'").limit(2)
    near = store.around_windows(stored, top, P)
    wanted = {(r.host_key, r.day) for r in store.window_days(top, P).collect()}
    assert {(r.host_key, r.day) for r in near.collect()} <= wanted and sorted(map(str, incidents.incident_events(near, top, P).select("row", "incident_id").collect())) == sorted(map(str, incidents.incident_events(stored, top, P).select("row", "incident_id").collect()))
    assert sorted(map(str, incidents.previous_categories(near, top, P).collect())) == sorted(map(str, incidents.previous_categories(stored, top, P).collect()))
    plan = lambda df: df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    filters = lambda text: " ".join(re.findall(r"PartitionFilters: \[[^\]]*", text))
    assert "day#" in filters(plan(near))
    seen = store.view(stored, host="h2", process="cron", since="2026-10-07 00:00:00", until="2026-10-12 00:00:00")
    assert sorted(r.row for r in seen.collect()) == [k for k in range(60) if k % 3 == 2 and k % 5 == 0 and k % 9 != 8 and datetime(2026, 10, 7) <= rows[k][0] < datetime(2026, 10, 12)]
    told = plan(seen)
    assert "EqualTo(host_key,h2)" in told and "EqualTo(process,cron)" in told and "PushedFilters" in told and "day#" in filters(told)
    assert store.view(stored).count() == 61 and store.incident_view(top, "h0").count() == 0 and store.incident_view(top).count() == top.count()


def test_entry_without_a_package_of_the_training_data_part():
    """A package that the subpackage needs is missing: its queries go, all others stay."""
    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 55 and set(s) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


@pytest.mark.parametrize(("bitmaps", "hot"), [(1 << 13, 1 / 10_000), (1 << 13, 0.2), (1, 2.0)])
def test_repeated_rows_pass_a_filter(spark, many_parts, tmp_path, monkeypatch, bitmaps, hot):
    """One line makes up a third of the rows, others stand two or three times, most stand alone; also with a filter far too small."""
    monkeypatch.setattr(identity, "MOST_BITMAPS", bitmaps)
    monkeypatch.setattr(identity, "HOT_SHARE", hot)
    r = random.Random(5)
    lines = [0] * 4000 + [k for k in range(1, 1500) for _ in range(r.choice((2, 3)))] + list(range(10_000, 14_000))
    r.shuffle(lines)
    path = str(tmp_path / "rows")
    columns = "row long, timestamp timestamp, host string, host_ip string, process string, pid string, facility string, severity string, raw string, source string, flags array<string>"
    spark.createDataFrame([(k, None, f"h{x % 3}" if x % 5 else "unknown", "", "p", None, "", "", f"line {x}", "f", ["seen"]) for k, x in enumerate(lines)], columns).write.parquet(path)
    events = spark.read.parquet(path)
    first: dict[int, int] = {}
    want = {k: ["seen"] + ["identical_records"] * (first.setdefault(x, k) < k) + ["missing_host"] * (x % 5 == 0) for k, x in enumerate(lines)}
    got = with_identity_flags(events)
    assert got.columns == events.columns and {x.row: x.flags for x in got.collect()} == want and got.count() == len(lines)
    assert with_identity_flags(events.filter("raw = 'line 10001'")).count() == 1 and with_identity_flags(events.limit(0)).count() == 0


def test_few_unique_rows_are_shuffled(spark):
    hashes = spark.range(60_000).select(F.xxhash64("id").alias("_h1"), F.xxhash64(F.lit(1), "id").alias("_h2"), "id")
    bits = -(-20_000 * 16 // (1 << 15))
    rows = hashes.withColumn("_bitmap", identity._places(bits)[0]).join(identity.bloom(hashes.filter("id < 20000"), bits), "_bitmap", "left")
    passed = rows.filter(identity.maybe(bits)).select((F.col("id") < 20_000).alias("repeated")).groupBy("repeated").count().collect()
    told = {r["repeated"]: r["count"] for r in passed}
    assert told[True] == 20_000 and told.get(False, 0) < 0.03 * 40_000


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keys", [["host"], ["source", "host"]])
def test_first_places_are_the_least_structs(spark, many_parts, keys):
    """Times before the epoch and with microseconds, rows far into a file, equal times in several files, a null key."""
    r = random.Random(7)
    times = [datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(1970, 1, 1), datetime(1902, 3, 4), START, START + timedelta(microseconds=1), datetime(9999, 12, 31, 23, 59, 59)]
    rows = [(r.choice("abc"), r.choice(["x", "y", None]), r.choice(times), r.choice([1, 2, 2**62 + k])) for k in range(300)]
    df = spark.createDataFrame(rows, "source string, host string, timestamp timestamp, row long").repartition(5)
    for at in (AT, WHERE):
        got = counted(df, keys, at)
        want = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.min(F.struct(*at)).alias("first"))
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert counted(df.limit(0), keys).count() == 0


def test_events_are_counted_in_hash_tables(spark, tmp_path):
    """With sources as scope, no aggregate of events sorts; else only the counts of sources are put together by a sort."""
    columns = "timestamp timestamp, source string, row long, host_key string, process string, pid string, facility string, severity string, host_ip string"
    spark.createDataFrame([(START, "f", 1, "h", "p", "1", "a", "b", "c")], columns).write.parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    plans = [lambda scope: windows.process_counts(e, 300, scope), lambda scope: correlate.associations(e, scope), lambda scope: tree.first_observations(e, scope)]
    for plan in plans:
        assert "SortAggregate" not in _plan(plan(("source",)))
        text = _plan(plan(()))
        assert text.count("HashAggregate") >= 2 and text.rindex("HashAggregate") > text.rfind("SortAggregate")
