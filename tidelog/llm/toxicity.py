"""Toxicity by a classifier chain.

The categories are predicted one after the other, the last being the labelled one. Each link is a logistic
regression on counts of chosen words and word beginnings and on the logits of the earlier links. In training,
these come from models that have not seen the row (out of fold), as they do in use.

The labels name no category besides toxic. The earlier categories are kinds of toxic wording found in the data: the
chosen words are parted by how they stand together in labelled toxic rows, and a toxic row is a case of each kind
that a fair share of its chosen words belongs to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Words, blocks, tidy
from tidelog.llm.decontaminate import _WORD
from tidelog.llm.linear import Lookup, fit_logistic, logit, sample, softmax, word_starts

#: Labelled rows that the chain is fitted on at most (more only where ids repeat).
SAMPLE_ROWS = 6000
FEATURES = 512
FOLDS = 4
#: Lengths in bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7)
CATEGORIES = ("kind_1", "kind_2", "toxic")
#: Share of a toxic row's chosen words that makes it a case of a kind.
LEAST_SHARE = 1 / 3


def _keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, feature keys) of every word and word beginning."""
    words = Words(data, offsets, _WORD)
    text = words.texts()
    starts = word_starts(data, words, BEGINNINGS)
    return np.concatenate([text, *(text[w] for w, _ in starts)]), np.concatenate([words.hashes, *(h for _, h in starts)])


def _matrix(rows: int, text: np.ndarray, feature: np.ndarray, features: int) -> np.ndarray:
    """Damped counts: log(1 + n)."""
    out = np.bincount(text * features + feature, minlength=rows * features).reshape(rows, features)
    return np.log1p(out).astype(np.float32)


@dataclass
class Chain:
    keys: np.ndarray
    links: list[np.ndarray]
    threshold: float
    #: Out-of-fold log loss of the last link without the earlier categories less that with them.
    gain: float = 0.0

    def lookup(self) -> Lookup:
        return Lookup(self.keys)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0), np.float32)
        for w in self.links:
            z = np.hstack([x, logit(out), np.ones((len(x), 1), np.float32)]) @ w.T
            out = np.hstack([out, softmax(z)[:, 1:2]]).astype(np.float32)
        return out


def _select(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """Keys most associated with toxic texts (likelihood ratio of document frequencies), FEATURES of them at most."""
    size = 1 << 22
    place = lambda keys: (keys & np.uint64(size - 1)).astype(np.int64)
    packed = pa.array(texts, pa.large_string())
    seen, pos = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for first, _, data, offsets in blocks(packed):
        text, keys = _distinct(*_keys(data, offsets))
        np.add.at(seen, place(keys), 1)
        np.add.at(pos, place(keys[toxic[first + text] == 1]), 1)
    good = np.argsort(-_association(seen, pos, len(toxic), int(toxic.sum())))[: 8 * FEATURES]
    chosen = np.zeros(size, bool)
    chosen[good] = True
    owner, keys = [], []
    for first, _, data, offsets in blocks(packed):  # once more, for the chosen buckets alone
        text, key = _keys(data, offsets)
        mine = chosen[place(key)]
        text, key = _distinct(text[mine], key[mine])
        owner.append(first + text)
        keys.append(key)
    owner, keys = np.concatenate(owner), np.concatenate(keys)
    names, number = np.unique(keys, return_inverse=True)
    seen, pos = np.bincount(number), np.bincount(number, weights=toxic[owner])
    value = _association(seen, pos, len(toxic), int(toxic.sum()))
    best = np.argsort(-value)[:FEATURES]
    return names[best[value[best] > 10]]


def _distinct(text: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, text))
    text, keys = text[order], keys[order]
    first = np.append(True, (text[1:] != text[:-1]) | (keys[1:] != keys[:-1]))[: len(text)]
    return text[first], keys[first]


def _association(seen: np.ndarray, pos: np.ndarray, n: int, positives: int) -> np.ndarray:
    """G statistic of positive association, 0 where there is none."""
    base = positives / max(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        expected = seen * base
        g = 2 * (pos * np.log(pos / expected) + (seen - pos) * np.log(np.maximum(seen - pos, 1e-9) / (seen * (1 - base))))
    return np.where((pos > expected) & (seen > 2), np.nan_to_num(g), 0.0)


def kinds(x: np.ndarray) -> list[np.ndarray]:
    """Cases (0/1 of each row) of the earlier categories among toxic rows with features x.

    The features are parted by the sign of the main direction in which their columns, scaled to length one, differ.
    """
    columns = x / np.maximum(np.linalg.norm(x, axis=0), 1e-9)
    columns = columns - columns.mean(axis=1, keepdims=True)
    v = np.linspace(1, 2, len(x))
    for _ in range(50):
        v = columns @ (v @ columns)
        v /= np.linalg.norm(v) + 1e-12
    side = v @ columns > 0
    total = np.maximum(x.sum(axis=1), 1e-9)
    return [(x[:, part].sum(axis=1) / total >= LEAST_SHARE).astype(np.int64) for part in (side, ~side)]


def train(labelled: list[tuple[str | None, int]]) -> Chain | None:
    """Fit the chain on (text, toxic 0/1) rows; None if either class has fewer than FOLDS rows."""
    texts, toxic = [t or "" for t, _ in labelled], np.array([y for _, y in labelled], dtype=np.int64)
    if min(toxic.sum(), len(toxic) - toxic.sum()) < FOLDS:
        return None
    keys = _select(texts, toxic)
    if not len(keys):
        return None
    chain = Chain(keys, [], 0.5)
    x = _features(chain.lookup(), texts)
    rows, labels = np.flatnonzero(toxic == 1), []
    for cases in kinds(x[rows]):
        labels.append(np.zeros(len(texts), np.int64))
        labels[-1][rows] = cases
    fold = np.random.default_rng(20240301).permutation(len(texts)) % FOLDS

    def out_of_fold(inputs: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(texts), np.float32)
        for k in range(FOLDS):
            held = fold == k
            out[held] = softmax(np.hstack([inputs[held], np.ones((held.sum(), 1), np.float32)]) @ _fit(inputs[~held], y[~held]).T)[:, 1]
        return out

    earlier = np.zeros((len(texts), 0), np.float32)
    for y in [*labels, toxic]:
        inputs = np.hstack([x, logit(earlier)]).astype(np.float32)
        chain.links.append(_fit(inputs, y))
        earlier = np.hstack([earlier, out_of_fold(inputs, y)[:, None]])
    chain.gain = _loss(out_of_fold(x, toxic), toxic) - _loss(earlier[:, -1], toxic)
    chain.threshold = best_threshold(earlier[:, -1], toxic)
    return chain


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if y.min() == y.max():  # one class only: its rate, smoothed
        w = np.zeros((2, x.shape[1] + 1), np.float32)
        w[1, -1] = logit(np.array([(y.sum() + 0.5) / (len(y) + 1)]))[0]
        return w
    return fit_logistic(x, y, ridge=0.2, rounds=150)


def _loss(p: np.ndarray, y: np.ndarray) -> float:
    return float(-np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-6, 1)).mean())


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap in which F0.5 (precision counts twice) on out-of-fold predictions is best."""
    order = np.argsort(-p)
    hits = np.cumsum(y[order])
    score = 1.25 * hits / (np.arange(1, len(p) + 1) + 0.25 * y.sum())
    k = int(np.argmax(score))
    below = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + below) / 2)


def _features(lookup: Lookup, texts: list[str]) -> np.ndarray:
    return np.vstack([_block(lookup, data, offsets) for _, _, data, offsets in blocks(pa.array(texts, pa.large_string()))])


def _block(lookup: Lookup, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    text, keys = _keys(data, offsets)
    place, number = lookup.find(keys)
    return _matrix(len(offsets) - 1, text[place], number, len(lookup.keys))


def _trained(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str) -> Chain | None:
    known = labels.select(F.col(label_id).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y is not null")
    known = sample(known, "_id", SAMPLE_ROWS)
    texts = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = texts.join(F.broadcast(known), "_id").select("_id", "_text", (F.col("_y") > 0).cast("int").alias("_y")).orderBy("_id", "_y", "_text").toArrow()
    return train(list(zip(rows["_text"].to_pylist(), rows["_y"].to_pylist(), strict=True)))


def _scores(chain, column: pa.Array) -> np.ndarray:
    if chain.value is None:
        return np.zeros((len(column), len(CATEGORIES)), np.float32)
    lookup = chain.value.lookup()
    return np.vstack([np.zeros((0, len(CATEGORIES)), np.float32), *(chain.value.probabilities(_block(lookup, data, offsets)) for _, _, data, offsets in blocks(column))])


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(doc_id, p_kind_1, p_kind_2, p_toxic, toxic) of each row.

    A null or empty text has no features and gets the base rates. Labels that are null or have no document are
    left out of the training; with too few labels of either class, all probabilities are 0 and nothing is toxic.
    Repeated rows and null ids keep their rows; other columns are left out. An empty table gives no rows.
    """
    chain = _trained(df, labels, id_col, text_col, label_id, label_col)
    shared = df.sparkSession.sparkContext.broadcast(chain)
    threshold = chain.threshold if chain else 2.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _scores(shared, batch.column("text")).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= threshold)], names=["doc_id", *(f"p_{c}" for c in CATEGORIES), "toxic"])

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(tidy(score), "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean")


def clean(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, that are not toxic."""
    chain = _trained(df, labels, id_col, text_col, "doc_id", "toxic")
    shared = df.sparkSession.sparkContext.broadcast(chain)
    threshold = chain.threshold if chain else 2.0

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared, batch.column(batch.schema.get_field_index(text_col)))[:, -1] < threshold))

    return df.mapInArrow(tidy(keep), df.schema)
