"""Rule catalogues as JSON files, for users who edit categories, causes and references."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidelog.catalog import Catalog, Category, Cause, Technique

#: The shape of a file. ``mitre`` maps a technique's id to what is known of it; exclude, gate and a cause's mitre may be left out.
SCHEMA = """version string, mitre_reviewed string, mitre map<string, struct<name: string, url: string, condition: string>>,
categories array<struct<id: string, label: string, patterns: array<string>, exclude: array<string>>>,
causes array<struct<id: string, title: string, kind: string, categories: array<string>, min_count: int, min_percent: int, checks: array<string>, gate: string, mitre: array<string>>>"""
GATES = ("", "auth_peer", "service_failure", "scan_evidence")


def read_catalog(spark: SparkSession, path: str) -> Catalog:
    """The catalogue in a JSON file, from any file system that Spark reads; techniques by id, which no result depends on.

    Raises ValueError where it isn't one: unreadable JSON, a part without a value that it needs, an id given twice, a cause of
    an unknown category, gate or technique, or a pattern that is no regular expression.
    """
    rows = spark.read.schema(f"{SCHEMA}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path, multiLine=True).limit(2).collect()
    if len(rows) != 1 or rows[0]["_bad"] is not None:
        raise ValueError(f"{path} isn't one JSON object of a catalogue.")
    c = rows[0]
    categories = tuple(Category(x["id"], x["label"], tuple(x["patterns"] or ()), tuple(x["exclude"] or ())) for x in c["categories"] or ())
    causes = tuple(Cause(x["id"], x["title"], x["kind"], tuple(x["categories"] or ()), x["min_count"], x["min_percent"], tuple(x["checks"] or ()), x["gate"] or "", tuple(x["mitre"] or ())) for x in c["causes"] or ())
    techniques = tuple(Technique(k, x["name"], x["url"], x["condition"]) for k, x in sorted((c["mitre"] or {}).items()))
    found = Catalog(categories, causes, techniques, version=c["version"] or "", reviewed=c["mitre_reviewed"] or "")
    check(spark, found)
    return found


def check(spark: SparkSession, catalog: Catalog) -> None:
    """Raise ValueError where parts of a catalogue don't fit together."""
    for kind, parts in (("category", catalog.categories), ("cause", catalog.causes), ("technique", catalog.techniques)):
        ids = [x.id for x in parts]
        if not all(ids) or len(set(ids)) < len(ids):
            raise ValueError(f"Each {kind} needs an id of its own.")
    if not catalog.categories or any(not x.patterns or not x.label or x.id == catalog.other for x in catalog.categories):
        raise ValueError(f"A catalogue needs categories, each with a label and patterns, and none named {catalog.other}.")
    known, told = {x.id for x in catalog.categories}, {x.id for x in catalog.techniques}
    for cause in catalog.causes:
        if not cause.title or not cause.categories or not set(cause.categories) <= known or not set(cause.mitre) <= told or cause.gate not in GATES:
            raise ValueError(f"Cause {cause.id} has no title, or an unknown category, technique or gate.")
        if cause.min_count is None or cause.min_count < 1 or cause.min_percent is None or not 0 <= cause.min_percent <= 100:
            raise ValueError(f"Cause {cause.id} needs a count of at least 1 and a share from 0 to 100.")
    patterns = [p for x in catalog.categories for p in (*x.patterns, *x.exclude)]
    text = F.col("id").cast("string")
    try:
        spark.range(1).select(*(text.rlike(p).alias(f"p{k}") for k, p in enumerate(patterns))).collect()
    except (PySparkException, Py4JJavaError) as e:
        raise ValueError("A pattern of the catalogue is no regular expression.") from e


def as_json(catalog: Catalog) -> str:
    """The text of a catalogue's file, from which a user may begin."""
    known = lambda d: {k: v for k, v in d.items() if v not in ("", ())}
    return json.dumps(
        {
            "version": catalog.version,
            "mitre_reviewed": catalog.reviewed,
            "categories": [known(vars(x)) for x in catalog.categories],
            "causes": [known(vars(x)) for x in catalog.causes],
            "mitre": {x.id: {"name": x.name, "url": x.url, "condition": x.condition} for x in catalog.techniques},
        },
        ensure_ascii=False,
        indent=1,
    )
