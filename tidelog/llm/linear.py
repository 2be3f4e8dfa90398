"""Small linear models in numpy, and hashed word features of text blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import _LOWER, Words, buffers, mix, powers

_LUT_BITS = 22


#: Bytes of text in a sample, but for its last row.
SAMPLE_BYTES = 32 << 20


def sample(df: DataFrame, key: str, rows: int, text: str | None = None) -> DataFrame:
    """``rows`` rows at most, of different keys and from the whole table: those of the smallest hashes of ``key``.

    Of the rows of one key the smallest stands for all, so that a key that is repeated often gives one row. If ``text``
    names a column, the sample ends with the row in which its bytes reach SAMPLE_BYTES.
    """
    h = F.xxhash64(F.lit(17), F.col(key))
    total, share = df.count(), 0.0
    while True:
        share = 16 * share or 2 * rows / max(total, 1)
        part = df if share >= 1 else df.filter(h < F.lit(int((share - 0.5) * (1 << 64))))
        last, found = part.select(h.alias("h")).distinct().orderBy("h").limit(rows).agg(F.max("h"), F.count(F.lit(1))).first()
        if found == rows or share >= 1:
            break
    chosen = df.filter(h <= F.lit(last)) if last is not None else df.limit(0)
    chosen = chosen.groupBy(h.alias("_h")).agg(F.min(F.struct(*df.columns)).alias("_row"))
    if text:
        ahead = F.sum(F.coalesce(F.octet_length(f"_row.{text}"), F.lit(0))).over(Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, -1))
        chosen = chosen.withColumn("_ahead", F.coalesce(ahead, F.lit(0))).filter(F.col("_ahead") < SAMPLE_BYTES)
    return chosen.select("_row.*")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 200) -> np.ndarray:
    """Weights (classes, features + 1; bias last) of a softmax regression by accelerated gradient descent.

    y holds class numbers. Equal rows are put together with a weight first: most texts have no feature at all.
    """
    classes = int(y.max()) + 1
    rows = np.ascontiguousarray(np.hstack([x, np.ones((len(x), 1)), y[:, None]]).astype(np.float32))
    _, first, weight = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_index=True, return_counts=True)
    x, y, weight = rows[first, :-1], rows[first, -1].astype(np.int64), weight.astype(np.float32)[:, None]
    goal = np.eye(classes, dtype=x.dtype)[y]
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(8):  # largest eigenvalue, for the step
        v = x.T @ (weight[:, 0] * (x @ v))
        v /= np.linalg.norm(v) + 1e-12
    step = 1.0 / (0.5 * float(v @ (x.T @ (weight[:, 0] * (x @ v)))) * 1.1 + ridge)
    weights = np.zeros((classes, x.shape[1]), x.dtype)
    ahead, momentum = weights.copy(), 1.0
    for _ in range(rounds):
        gradient = ((softmax(x @ ahead.T) - goal) * weight).T @ x
        gradient[:, :-1] += ridge * ahead[:, :-1]
        new = ahead - np.float32(step) * gradient
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, weights, momentum = new + np.float32((momentum - 1) / after) * (new - weights), new, after
    return weights


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class Lookup:
    """Numbers of known 64-bit keys."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.lut = np.zeros(1 << _LUT_BITS, dtype=bool)
        self.lut[self.keys & np.uint64((1 << _LUT_BITS) - 1)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in values, numbers of the keys there) of all known values."""
        place = np.flatnonzero(self.lut[values & np.uint64((1 << _LUT_BITS) - 1)])
        if not len(self.keys):
            return place[:0], place[:0]
        at = np.minimum(np.searchsorted(self.keys, values[place]), len(self.keys) - 1)
        good = self.keys[at] == values[place]
        return place[good], self.order[at[good]]


def word_starts(data: np.ndarray, words: Words, lengths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length, (word numbers, hashes) of the first so many bytes of the words that are longer."""
    n = len(data)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    out = []
    for k in lengths:
        which = np.flatnonzero(words.ends - words.starts > k)
        at = words.starts[which]
        out.append((which, mix((sums[at + k] - sums[at]) * down[at] + np.uint64(k))))
    return out


def texts_of(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return buffers(pa.array(strings, pa.large_string()))
