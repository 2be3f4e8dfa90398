"""Nulls, empty and long texts, repeated rows, clashing extra columns and empty tables, for every operator."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import bpe, curves, decontaminate, langid, licenses, lm, minhash, sharding, toxicity, warc
from tidelog.llm.common import shared_folder

WORDS = "the of and to in is that it was for on are with as his they at be this from".split()
PROSE = [" ".join(WORDS[(k * 7 + j * j) % 20] + str((k * j) % 9) for j in range(60)) for k in range(12)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, _text string, _row long, key long, `component` int"
TOKENS = public_tokenizers.path("word_bpe_49k.json")
PIECES = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None, "x", "y", 1, 2, 3) for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s") for k, t in enumerate(PROSE)]
    rows += [(20, None, None, None), (21, "", "en", ""), (None, PROSE[0], "en", "s"), (None, None, None, None), (3, PROSE[3], "en", "s"), (22, " \n\t ", "xx", "s"), (23, PROSE[1] * 2000, "en", "s"), (24, "é́ 日本 <|endoftext|>  x", "fr", "t"), (25, "one two", "en", "t"), (26, "One  TWO", "en", "t")]
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(12)] + [(None, 1, 1), (99, 1, None), (98, 0, 1)], "doc_id long, quality int, toxic int")


def test_license_scan(docs, nothing):
    model = licenses.fit(docs)
    assert licenses.scan(docs, model).count() == docs.count()
    assert {r.license for r in licenses.scan(docs, model).collect()} == {"unknown"}
    assert licenses.scan(nothing, licenses.fit(nothing)).count() == 0


def test_bpe(docs, nothing):
    got = bpe.encode(docs, TOKENS).collect()
    assert len(got) == docs.count() and {r.n_tokens for r in got if r.doc_id in (20, 21, 22)} == {0}
    assert bpe.decode(bpe.encode(docs, TOKENS), TOKENS).filter("doc_id = 25").first().text == "one</w> two</w>"
    assert bpe.encode(nothing, TOKENS).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c/", None), (4, "", ""), (None, "http://e/", "<p>é</p>"), (1, "http://a/", "<p>é</p>"), (5, "u", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, sha1 string, first int")
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    assert got == sorted([(1, 9, "response", None)] * 2 + [(2, 9, "revisit", 1), (0, 9, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, 300_000, "response", None)], key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0
    folder = shared_folder(spark)
    index = warc.write_archive(pages, folder)
    some = warc.read_archive(index.filter("page_id = 5"), folder).collect()
    assert [bytes(r.payload) for r in some] == [b"x" * 300_000]


def test_toxicity(docs, nothing, labels):
    assert toxicity.classify(docs, labels).count() == docs.count()
    assert {r.toxic for r in toxicity.classify(docs, labels.filter("toxic = 0")).collect()} == {False}
    assert toxicity.classify(nothing, labels).count() == 0
    assert toxicity.clean(docs, labels.limit(0)).columns == docs.columns


def test_neighbours(spark):
    v = lambda *x: [float(a) if a is not None else None for a in x]
    rows = [(0, v(1, 0)), (1, v(2, 0)), (2, v(0, 1)), (3, None), (4, v(0, 0)), (5, v(float("nan"), 1)), (6, v(None, 1)), (7, v(1, 2, 3)), (None, v(1, 1)), (50, v(1, 1)), (50, v(1, 1)), (8, v(3, 0))]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, embedding array<float>, label string, rank int")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in curves.search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 8, 1.0), (0, 3, 50, 0.707107), (0, 4, 2, 0.0), (50, 1, 0, 0.707107), (50, 2, 1, 0.707107), (50, 3, 2, 0.707107), (50, 4, 8, 0.707107)]
    assert curves.search(df.limit(0)).count() == 0


def test_language(docs, nothing):
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identify(docs.select("doc_id", *langid.of_documents()), model, ["doc_id"]).collect()}
    assert len(got) > 12 and got[0].language == "en"
    kept = langid.clean_documents(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id = 0").count() == 1
    assert langid.clean_documents(nothing, model).count() == 0
    for empty in (nothing, docs.withColumn("lang", F.lit(None).cast("string"))):  # no labels: nothing is told or rejected
        model = langid.fit(empty)
        told = langid.identify(empty.select("doc_id", *langid.of_documents()), model, ["doc_id"]).collect()
        assert len(told) == empty.count() and not any(r.rejected for r in told)
        assert langid.clean_documents(empty, model).count() == empty.count()


def test_near_duplicates(docs, nothing):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert (got[20].n_shingles, got[20].component_id, got[20].kept) == (0, 20, True)
    assert (got[26].component_id, got[26].kept, got[26].n_shingles) == (25, False, 1)
    assert got[None].component_id is None and got[None].kept
    assert minhash.near_duplicates(nothing).count() == 0
    kept = minhash.keep_one(docs)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(3) == 1 and ids.count(None) == 2 and 26 not in ids and kept.columns == docs.columns
    assert minhash.keep_one(nothing).count() == 0
    # Two texts under one id: the copy goes, the other stays.
    both = docs.filter("doc_id in (2, 4)").union(docs.filter("doc_id = 2").withColumn("doc_id", F.lit(7).cast("long"))).union(docs.filter("doc_id = 5").withColumn("doc_id", F.lit(7).cast("long")))
    assert sorted((r.doc_id, r.text) for r in minhash.keep_one(both).collect()) == sorted([(2, PROSE[2]), (4, PROSE[4]), (7, PROSE[5])])


def test_pipeline(spark, docs, nothing, labels, tmp_path):
    items = spark.createDataFrame([(1, PROSE[2])], "item_id long, text string")
    for name, table in (("some", docs), ("none", nothing), ("unlabelled", docs.withColumn("lang", F.lit(None).cast("string")))):
        folder = f"file://{tmp_path}/{name}"
        table.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        items.write.parquet(f"{folder}/benchmark.parquet")
        at = table
        for stage, function in corpus_pipeline.STAGES[:-1]:
            at = function(spark, at, folder)
            assert at.columns == docs.columns, stage
        got = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
        assert got == set() if name == "none" else {0, 1, 3} <= got and 2 not in got


def test_lm(docs, nothing):
    got = {r.doc_id: r for r in lm.score(docs, PIECES).collect()}
    assert got[20].n_tokens == 1 and got[20].n_known == 1 and got[23].n_tokens == 60 * 2000 - 1999 + 1
    assert lm.score(nothing, PIECES).count() == 0


def test_sharding(docs, nothing):
    rows = sharding.shard(docs, shards=4).collect()
    assert len(rows) == docs.count() and {r.law for r in rows} == {"bytes"}
    for s in {r["shard"] for r in rows}:
        assert sorted(r.slot for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sharding.shard(nothing).count() == 0


def test_decontamination(spark, docs, nothing):
    items = spark.createDataFrame([(1, PROSE[2][10:150], 1), (2, None, 1), (3, "", 1), (4, "!!", 1), (1, PROSE[2][10:150], 1)], "item_id long, text string, edits int")
    got = decontaminate.contaminated(docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(2, 1)} and got.count() == 2
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert decontaminate.contaminated(nothing, items).count() == 0 and decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert docs.select(F.count("*")).first()[0] == 22
