"""The driver's contract."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import REPO

DATA = "/root/testdata/sf0.001"
CHECKED = ["top1_incident_ranking", "win3_process_baseline", "agg5_incident_distributions", "agg12_hypotheses", "agg13_gated_hypotheses", "win10_auth_sequences", "top3_cited_evidence", "agg10_associations", "jn6_nearby", "agg18_diagnostics", "agg18_examples", "src6_file_diagnostics", "src9_limit", "snk4_ticket_facts"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    got, want = entry.queries()[name](spark, DATA), con.execute(entry.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in names]
    tidy = lambda r: tuple(round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)
    assert sorted(map(tidy, got.select(names).collect()), key=str) == sorted((tidy([r[i] for i in order]) for r in want.fetchall()), key=str)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_stands_without_the_training_data_part():
    code = "import sys; sys.modules['tidelog.llm'] = None; import tidelog.plans.analysis, tidelog.plans.queries, tidelog.sources.readers; assert not any(m.startswith('tidelog.llm.') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
