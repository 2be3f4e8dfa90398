"""What shows only on more rows than the smallest tables have: full windows, large row groups, scans that are cut anew."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
import pytest

from pyspark.sql import functions as F

from tidelog.functions.text import WHITE, strip
from tidelog.plans import queries
from tidelog.sources import readers


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    """Events in one row group; each host's windows hold some sixty, so that causes cite events after the first thirty."""
    folder = tmp_path_factory.mktemp("dense")
    begin = datetime(2024, 1, 5)
    late = lambda k: 7 * k % 3600 >= 2100
    rows = [(k, begin + timedelta(seconds=7 * k), k * 7919 % 40, "purchase" if late(k) else "view", '{"k": 1}') for k in range(4000)]
    con = duckdb.connect()
    con.execute("create table e (event_id bigint, ts timestamp, user_id bigint, event_type varchar, props varchar)")
    con.executemany("insert into e values (?, ?, ?, ?, ?)", rows)
    con.execute(f"copy e to '{folder}/events.parquet' (format parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["top3_evidence", "prj11_evidence_texts"])
def test_evidence_is_that_of_its_sql(spark, dense, name):
    import __spark_entry__

    con = duckdb.connect()
    con.execute(f"create view events as select * from '{dense}/events.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in __spark_entry__.queries()[name](spark, dense).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100


def test_records_are_dealt_by_their_number(spark, dense, monkeypatch):
    monkeypatch.setattr(queries, "ROWS_A_TASK", 300)
    parts = queries.records(spark, dense).select("row").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(parts) == 16 and max(p["count"] for p in parts) < 400


@pytest.mark.parametrize("quoted", [False, True])
def test_csv_records_when_a_later_scan_is_cut_otherwise(spark, tmp_path, monkeypatch, quoted):
    lines = [f'a{k},"b{k}{chr(10) if quoted else " "}c"' for k in range(3000)]
    (tmp_path / "x.csv").write_text("\n".join(["Computer,Message", *lines]) + "\n")
    whole = readers.cut

    def cut(df):
        out = whole(df)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        return out

    monkeypatch.setattr(readers, "cut", cut)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        source = f"file:{tmp_path}/x.csv"
        files = readers.CsvFiles(spark, [f"file://{tmp_path}/x.csv"], ",")
        got = sorted((r["row"], r["value"]) for r in files.records(files.plain + files.scanned).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert files.plain + files.scanned == [source] and got == list(enumerate(lines, 1))


def test_white_space_is_that_of_patterns(spark):
    every = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    df = spark.createDataFrame([(c + "x" + c,) for c in every], "c string").repartition(4)
    assert sorted(r[0] for r in df.filter(F.col("c").rlike(r"(?U)^\s")).selectExpr("substring(c, 1, 1)").collect()) == sorted(WHITE)
    assert df.filter(strip(F.col("c")) != F.regexp_replace("c", r"(?U)^\s+|\s+\z", "")).count() == 0
    odd = spark.createDataFrame([("",), (" \t　",), (" a b \n",), (None,)], "c string")
    assert [r[0] for r in odd.select(strip(F.col("c"))).collect()] == ["", "", "a b", None]
