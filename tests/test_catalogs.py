"""Catalogues in files."""

from __future__ import annotations

import json
from dataclasses import replace

import pytest

from tidelog.catalog import DEFAULT
from tidelog.sources import catalogs


def test_default_catalogue_comes_back(spark, tmp_path):
    (tmp_path / "c.json").write_text(catalogs.as_json(DEFAULT))
    assert catalogs.read_catalog(spark, f"file://{tmp_path}/c.json") == replace(DEFAULT, techniques=tuple(sorted(DEFAULT.techniques, key=lambda x: x.id)))


@pytest.mark.parametrize(
    "change",
    [
        lambda c: c["categories"].append(c["categories"][0]), lambda c: c["causes"][0].update(categories=["none"]), lambda c: c["causes"][0].update(gate="none"), lambda c: c["causes"][0].update(mitre=["T0"]),
        lambda c: c["causes"][0].update(min_percent=101), lambda c: c["causes"][0].pop("min_count"), lambda c: c["categories"][0].update(patterns=[]), lambda c: c["categories"][0].update(patterns=["(open"]), lambda c: c["categories"][0].update(id="other"), lambda c: c["categories"][0].pop("id"), lambda c: c.update(categories=[]),
    ],
)
def test_faults_are_told(spark, tmp_path, change):
    c = json.loads(catalogs.as_json(DEFAULT))
    change(c)
    (tmp_path / "c.json").write_text(json.dumps(c))
    with pytest.raises(ValueError):
        catalogs.read_catalog(spark, f"file://{tmp_path}/c.json")


@pytest.mark.parametrize("text", ["", "{", "[]", "{} x"])
def test_other_files_are_no_catalogues(spark, tmp_path, text):
    (tmp_path / "c.json").write_text(text)
    with pytest.raises(ValueError):
        catalogs.read_catalog(spark, f"file://{tmp_path}/c.json")
