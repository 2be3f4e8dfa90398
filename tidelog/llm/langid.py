"""Language identification by Bayesian fusion of several kinds of evidence.

The posterior of a language is the product of
- the likelihood of the text's byte trigrams, damped, as neighbouring trigrams tell the same thing twice;
- the likelihood of the declared markup language and of the address suffix, both from counts over all rows;
- the prior of the host: counts over all rows, smoothed towards those of its domain, these towards the total.

The counts are sums of text posteriors, made by grouped aggregation over the whole table. A further class,
``und``, stands for byte sequences of no known language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import _LOWER, blocks, stored, tidy
from tidelog.llm.linear import sample

#: Labelled rows that the trigram model is fitted on at most (more only where ids repeat).
SAMPLE_ROWS = 3000
BUCKETS = 1 << 16
#: A text's likelihood counts as that of so many independent trigrams at most.
INDEPENDENT = 60.0
UND = "und"
UND_PRIOR = 1e-3
#: Strength, in rows, of the pull of a host to its domain, of a domain to the total, of a small table to even shares.
PULL = 20.0
#: A row is rejected as long as no language reaches this posterior.
LEAST_POSTERIOR = 0.5
#: Bytes that carry language (letters, white space, everything beyond ASCII); others read as a space.
_LETTER = np.full(256, 32, dtype=np.uint8)
_LETTER[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams that hold a letter, and their texts' bounds among them."""
    letters = _LETTER[_LOWER[data]]
    n = max(len(data) - 2, 0)
    code = letters[:n].astype(np.uint32) << 16 | letters[1 : n + 1].astype(np.uint32) << 8 | letters[2 : n + 2]
    good = (letters[1 : n + 1] != 32) | (letters[2 : n + 2] != 32)
    for edge in (1, 2):  # not over the end of a text
        at = offsets[1:-1] - edge
        good[at[(at >= 0) & (at < n)]] = False
    bounds = np.concatenate([[0], np.cumsum(good)])[np.minimum(offsets, n)]
    return ((code[good] * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64), bounds


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # [language, bucket] log probability

    def log_likelihood(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[text, language and und]: damped log likelihoods; zeros where there is no letter."""
        buckets, bounds = trigrams(data, offsets)
        n = np.diff(bounds)
        out = np.zeros((len(n), len(self.table)))
        full = n > 0
        for k, row in enumerate(self.table):
            sums = np.concatenate([[0.0], np.cumsum(row[buckets], dtype=np.float64)])
            out[full, k] = (sums[bounds[1:]] - sums[bounds[:-1]])[full] / n[full]
        return out * (n * INDEPENDENT / (n + INDEPENDENT))[:, None]


def train(texts: list[str | None], labels: list[str]) -> TextModel:
    """Trigram frequencies of each label, add-0.1 smoothed, and the even distribution as ``und``."""
    languages = sorted(set(labels))
    of = np.array([languages.index(x) for x in labels], dtype=np.int64)
    counts = np.full((len(languages), BUCKETS), 0.1)
    for first, last, data, offsets in blocks(pa.array([t or "" for t in texts], pa.large_string())):
        buckets, bounds = trigrams(data, offsets)
        who = np.repeat(of[first:last], np.diff(bounds))
        for k in range(len(languages)):
            counts[k] += np.bincount(buckets[who == k], minlength=BUCKETS)
    table = np.log(counts / counts.sum(axis=1, keepdims=True))
    return TextModel(languages, np.vstack([table, np.full((1, BUCKETS), -np.log(BUCKETS))]).astype(np.float32))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> TextModel:
    """The text model of a bounded sample of rows with a label."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.lower(F.trim(label_col)).alias("_label")).filter("_label <> '' and _id is not null")
    got = sample(rows, "_id", SAMPLE_ROWS, "_text").orderBy("_id", "_label", "_text").toArrow()
    return train(got["_text"].to_pylist(), got["_label"].to_pylist())


def evidence(text: Column, host: Column, domain: Column | None = None, declared: Column | None = None, suffix: Column | None = None) -> list[Column]:
    """The columns that the operators read. Missing evidence is null and counts for nothing."""
    null = F.lit(None).cast("string")
    tidy = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    declared = tidy(F.regexp_extract(F.trim(declared), r"^([A-Za-z]{2,8})", 1)) if declared is not None else null
    host = tidy(host)
    return [text.alias("_text"), host.alias("_host"), (tidy(domain) if domain is not None else host).alias("_domain"), declared.alias("_declared"), (tidy(suffix) if suffix is not None else null).alias("_suffix")]


def of_documents() -> list[Column]:
    """Documents: the source is the host, the language column the declaration."""
    return evidence(F.col("text"), F.col("source"), declared=F.col("lang"))


def of_pages() -> list[Column]:
    """Pages: text without markup, host and suffix of the URL, language attribute of the html element."""
    html, host = F.coalesce("html", F.lit("")), F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    declared = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z-]+)", 1)
    domain = F.regexp_extract(host, r"([^.]+\.(?:(?:ac|co|com|edu|gov|net|org)\.[A-Za-z]{2}|[^.]+))$", 1)
    return evidence(text, host, domain, declared, F.regexp_extract(host, r"\.([^.]+)$", 1))


def _text_posteriors(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in blocks(batch.column("_text")):
                z = model.value.log_likelihood(data, offsets)[:, :-1]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[first:last] for c in ("_host", "_domain", "_declared", "_suffix")), *(pa.array(p[:, k]) for k in range(p.shape[1]))], names=["_host", "_domain", "_declared", "_suffix", *(f"p{k}" for k in range(p.shape[1]))])

    return run


def _counts(df: DataFrame, model: TextModel, shared) -> dict[str, DataFrame]:
    """Stored tables of smoothed counts over all rows: host prior; likelihood of declaration and of suffix."""
    n = len(model.languages)
    of = [f"p{k}" for k in range(n)]
    schema = "_host string, _domain string, _declared string, _suffix string, " + ", ".join(f"{p} double" for p in of)
    rows = df.select("_text", "_host", "_domain", "_declared", "_suffix").mapInArrow(tidy(_text_posteriors(shared)), schema)
    sums = [F.sum(p).alias(p) for p in of]
    cube = stored(rows.groupBy("_host", "_domain", "_declared", "_suffix").agg(*sums), "counts")
    total = [x or 0.0 for x in cube.agg(*sums).first()]
    share = [(x + PULL / n) / (sum(total) + PULL) for x in total]
    # A prior: each level is pulled to the one above.
    pulled = lambda x, base: [(F.col(f"{x}{p}") + PULL * base[k]) / (sum((F.col(f"{x}{q}") for q in of), F.lit(0.0)) + PULL) for k, p in enumerate(of)]
    domains = cube.filter("_domain is not null").groupBy("_domain").agg(*sums).select("_domain", *(c.alias(f"d{k}") for k, c in enumerate(pulled("", [F.lit(s) for s in share]))))
    hosts = cube.filter("_host is not null").groupBy("_host", "_domain").agg(*sums).join(domains, "_domain")
    prior = hosts.select("_host", F.array(*(F.log(c) for c in pulled("", [F.col(f"d{k}") for k in range(n)]))).alias("_prior"))
    out = {"_host": stored(prior.dropDuplicates(["_host"]), "host_prior")}
    for name in ("_declared", "_suffix"):
        seen = cube.filter(f"{name} is not null").groupBy(name).agg(*sums)
        kinds, *whole = seen.agg(F.count(F.lit(1)), *sums).first()
        like = [F.log((F.col(p) + 0.5) / (F.lit(whole[k] or 0.0) + 0.5 * (kinds + 1))) for k, p in enumerate(of)]
        out[name] = stored(seen.select(name, F.array(*like).alias(f"{name}_ll")), f"likelihood{name}")
    return out | {"share": share}


def _fused(model: TextModel, share: list[float], batch: pa.RecordBatch) -> np.ndarray:
    """[row, language and und] posteriors."""
    at = batch.schema.get_field_index
    text = np.vstack([np.zeros((0, len(model.table))), *(model.log_likelihood(data, offsets) for _, _, data, offsets in blocks(batch.column(at("_text"))))])
    prior = _given(batch.column(at("_prior")), np.log(share))
    for name in ("_declared_ll", "_suffix_ll"):
        prior = prior + _given(batch.column(at(name)), np.zeros(len(share)))
    top = prior.max(axis=1, keepdims=True)
    prior = prior - top - np.log(np.exp(prior - top).sum(axis=1, keepdims=True))
    z = text + np.hstack([prior + np.log(1 - UND_PRIOR), np.full((len(prior), 1), np.log(UND_PRIOR))])
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _given(column: pa.Array, default: np.ndarray) -> np.ndarray:
    """Rows of a list column, ``default`` where it is null."""
    out = np.tile(default, (len(column), 1))
    valid = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if len(valid):
        out[valid] = column.drop_null().flatten().to_numpy().reshape(-1, len(default))
    return out


def _with_evidence(df: DataFrame, model: TextModel) -> tuple[DataFrame, list[float], object]:
    shared = df.sparkSession.sparkContext.broadcast(model)
    tables = _counts(df, model, shared)
    # No hint: Spark broadcasts these by their size on disk, or joins by key beyond its limit.
    for name in ("_host", "_declared", "_suffix"):
        df = df.join(tables[name], name, "left")
    return df, tables["share"], shared


def identify(df: DataFrame, model: TextModel, keys: list[str]) -> DataFrame:
    """``keys`` of each row with language, posterior, declared language, text_chars and rejected.

    ``df`` holds the columns of ``evidence``. A model without languages, as of a table without labels, tells nothing: every row
    is ``und``, its posterior null, and none is rejected. A null text, or one without letters, is told by the other evidence
    alone. Rejected are rows of language ``und`` and those whose best posterior is under LEAST_POSTERIOR. Repeated
    rows keep their rows and count as often; an empty table gives no rows.
    """
    if not model.languages:
        return df.select(*keys, F.lit(UND).alias("language"), F.lit(None).cast("double").alias("posterior"), F.col("_declared").alias("declared"), F.lit(False).alias("rejected"))
    rows, share, shared = _with_evidence(df, model)
    fields = [rows.schema[k] for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*shared.value.languages, UND]
        for batch in batches:
            p = _fused(shared.value, share, batch)
            best = p.argmax(axis=1)
            top = p[np.arange(len(p)), best]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keys), pa.array([names[b] for b in best], pa.string()), pa.array(top), batch.column(batch.schema.get_field_index("_declared")), pa.array((best == len(names) - 1) | (top < LEAST_POSTERIOR))], names=[*keys, "language", "posterior", "declared", "rejected"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "language string, posterior double, declared string, rejected boolean"])
    return rows.mapInArrow(tidy(run), schema)


def clean_documents(df: DataFrame, model: TextModel) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose language is known; all rows if the model has no languages."""
    if not model.languages:
        return df
    # The row travels as one column, so that its names can't clash with those of the evidence.
    rows, share, shared = _with_evidence(df.select(F.struct("*").alias("_row"), *of_documents()), model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _fused(shared.value, share, batch)
            best = p.argmax(axis=1)
            good = (best < p.shape[1] - 1) & (p.max(axis=1) >= LEAST_POSTERIOR)
            row = batch.column(batch.schema.get_field_index("_row")).filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(row.flatten(), names=[f.name for f in row.type])

    return rows.mapInArrow(tidy(keep), df.schema)
