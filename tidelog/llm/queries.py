"""Queries of the training-data operators, each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import alignment, bpe, curves, decontaminate, hardneg, langid, licenses, lm, minhash, sharding, substrings, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return licenses.scan(documents, licenses.fit(documents))


def op2_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.search(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (page_id null) and all pages (doc_id null), with one model of the documents' languages."""
    documents, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    rows = documents.select("doc_id", F.lit(None).cast("long").alias("page_id"), *langid.of_documents()).union(pages.select(F.lit(None).cast("long"), "page_id", *langid.of_pages()))
    return langid.identify(rows, langid.fit(documents), ["doc_id", "page_id"])


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"), (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=24)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    rows = rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hardneg.mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents"), length=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_bpe_chunk_reuse": op2_bpe_chunk_reuse,
    "op3_warc": op3_warc,
    "op4_toxicity": op4_toxicity,
    "op5_hilbert_neighbours": op5_hilbert_neighbours,
    "op6_language_id": op6_language_id,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_sharding": op9_sharding,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_token_alignment": op13_token_alignment,
}
#: The records that a page table must give, their digests in base32 by groups of five bits of the hexadecimal ones.
_WARC_SQL = """with p as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
n as (select *, list_transform(range(1, 41), lambda i: instr('0123456789abcdef', hex[i]) - 1) as half from p),
d as (select page_id, url, strlen(html) as payload_bytes, array_to_string(list_transform(range(32), lambda g: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((half[g * 5 // 4 + 1] * 16 + coalesce(half[g * 5 // 4 + 2], 0)) // (2 ** (3 - g * 5 % 4))::bigint) % 32 + 1]), '') as payload_digest from n),
f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to, url from f"""
#: All pairs of documents that share a shingle, linked by their whole sets, and what is reachable from each document.
_NEAR_DUPLICATES_SQL = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select doc_id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')] else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) end as shingles from w),
g as (select doc_id, len(shingles) as n, unnest(shingles) as shingle from s),
pairs as (select a.doc_id as u, b.doc_id as v, a.n as nu, b.n as nv, count(*) as same from g a join g b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
links as (select u, v from pairs where 100 * same >= 85 * (nu + nv - same)), both_ways as (select u, v from links union all select v, u from links),
reach as (select doc_id, doc_id as other from s union select reach.doc_id, v from reach join both_ways on other = u)
select doc_id, len(shingles)::bigint as n_shingles, component_id, doc_id = component_id as kept from s join (select doc_id, min(other) as component_id from reach group by all) using (doc_id)"""
#: All anchors with all rows; products of whole numbers are exact in doubles here.
_HARD_NEGATIVES_SQL = """with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label as own, b.vec_id as id, b.label, list_inner_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, own, id as positive_id, score as positive_score from s where label = own qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, id))::int as rank, id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id, own) where label <> own and 80 * positive_score <= 100 * score and score <= positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, id) <= 5"""
#: Windows of 20 words by place; the words of all but the first of equal ones go.
_SUBSTRINGS_SQL = r"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
v as (select doc_id, list_transform(range(1, len(words) - 18), lambda i: array_to_string(words[i:i + 19], ' ')) as windows from w where len(words) >= 20),
g as (select doc_id, unnest(windows) as said, generate_subscripts(windows, 1) as i from v),
r as (select doc_id, i from g qualify row_number() over (partition by said order by doc_id, i) > 1),
c as (select distinct doc_id, unnest(range(i, i + 20)) as k from r),
o as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as k from w),
s as (select doc_id, count(c.k) as n_removed, coalesce(string_agg(word, ' ' order by o.k) filter (c.k is null), '') as kept from o left join c using (doc_id, k) group by doc_id)
select doc_id, len(words)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join s using (doc_id)"""
#: The other operators train models, search approximately or run a tokenizer: SQL can't express them, tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op3_warc": _WARC_SQL, "op7_minhash_near_dedup": _NEAR_DUPLICATES_SQL, "op11_hard_negatives": _HARD_NEGATIVES_SQL, "op12_substring_dedup": _SUBSTRINGS_SQL}
