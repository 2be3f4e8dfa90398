"""Hard negatives by coordinate pruning in length buckets.

Vectors are dealt to buckets by length, and large buckets to blocks by a hash of the id. A block keeps, for a coordinate
that an anchor asks for, the list of its rows sorted by that coordinate of the unit vector. A score that an anchor has
to reach bounds the angle to it, and with the angle the values that each coordinate of a row may have. The ranges of the
anchor's largest coordinates (its focus) are looked up in the sorted lists, their rows intersected, and the rest
verified by exact integer products. Anchors are a stated set of rows; they meet all rows, block by block, but only
buckets that are long enough.

First the positives of each anchor are found, with a bound that each block takes from its own first rows; then the
negatives, with the bound that the positives give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import stored

#: Components become floor(SCALE * x). Rows whose vector of these is MOST_LENGTH long or longer take no part.
SCALE, MOST_LENGTH = 256, 1 << 30
#: Rows of a block, anchors of a block, buckets for each doubling of the length.
ROWS, ANCHORS, PER_OCTAVE = 8192, 1024, 4
#: Coordinates of an anchor whose ranges are intersected; rows by which a block begins its bound.
FOCUS, FIRST_ROWS = 4, 64
_MARGIN = 1e-9


def usable(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector of int, length, bucket) of the rows that take part."""
    x = F.col(vector_col)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(x, lambda v: v.cast("double")).alias("v"))
    finite = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    rows = rows.withColumn("v", F.transform("v", lambda v: F.floor(F.greatest(F.least(v * SCALE, F.lit(4.0 * MOST_LENGTH)), F.lit(-4.0 * MOST_LENGTH)))))
    rows = rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))).filter(F.col("length") < MOST_LENGTH)
    bucket = F.when(F.col("length") < 1, -1).otherwise(F.floor(F.log2(F.greatest("length", F.lit(1.0))) * PER_OCTAVE).cast("int"))
    return rows.select("id", "label", F.col("v").cast("array<int>").alias("v"), "length", bucket.alias("bucket"))


def matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Rows of a list column as integers; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy()
    width = max([width or 0, *sizes.tolist()])
    out = np.zeros((len(sizes), width), np.int64)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), place] = column.flatten().to_numpy()
    return out


class Block:
    """Rows of one length bucket with their sorted coordinate lists, made as anchors ask for them."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.real = vectors.astype(np.float64)
        self.lengths = np.sqrt((self.real**2).sum(axis=1))
        self.longest = float(self.lengths.max(initial=0.0))
        self.unit = self.real / np.maximum(self.lengths, 1e-300)[:, None]
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._lists:
            order = np.argsort(self.unit[:, k], kind="stable")
            self._lists[k] = order, self.unit[order, k]
        return self._lists[k]

    def candidates(self, anchor: np.ndarray, least: int) -> np.ndarray | None:
        """Rows that may reach the score ``least`` with the anchor; None for all."""
        length = float(np.sqrt((anchor.astype(np.float64) ** 2).sum()))
        if least <= 0:
            return None
        most = length * self.longest
        if least > most * (1 + _MARGIN):
            return np.zeros(0, np.int64)
        reach = np.arccos(min(1.0, least / most))
        unit = anchor / length
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        angle = np.arccos(np.clip(unit[focus], -1, 1))
        low, high = np.cos(np.minimum(np.pi, angle + reach)) - _MARGIN, np.cos(np.maximum(0, angle - reach)) + _MARGIN
        spans = []
        for k, a, b in zip(focus.tolist(), low, high, strict=True):
            order, values = self.sorted_list(k)
            spans.append((*np.searchsorted(values, [a, b + _MARGIN]).tolist(), order))
        best = min(range(len(spans)), key=lambda j: spans[j][1] - spans[j][0])
        begin, end, order = spans[best]
        if 2 * (end - begin) > len(self.real):
            return None
        rows = order[begin:end]
        for j, k in enumerate(focus.tolist()):
            if j != best:
                x = self.unit[rows, k]
                rows = rows[(x >= low[j]) & (x <= high[j])]
        return rows

    def scores(self, rows: np.ndarray | None, anchors: np.ndarray) -> np.ndarray:
        """Exact products of rows (None: all) and anchors. Doubles hold them where lengths allow."""
        own = self.longest * float(np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=-1).max(initial=0)))
        held = self.real if own < 2**52 else self.vectors
        held = held if rows is None else held[rows]
        return (held @ anchors.T.astype(held.dtype)).astype(np.int64)

    def reached(self, anchors: np.ndarray, least: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, rows, their scores) of all rows that may reach the anchor's least score, and perhaps others."""
        wide = []
        for k, low in enumerate(least):
            rows = self.candidates(anchors[k], low)
            if rows is None:
                wide.append(k)
            elif len(rows):
                yield k, rows, self.scores(rows, anchors[k])
        every = np.arange(len(self.real))
        for first in range(0, len(wide), 64):  # where most rows remain, all are verified at once
            part = wide[first : first + 64]
            got = self.scores(None, anchors[part])
            for j, k in enumerate(part):
                yield k, every, got[:, j]


def _distinct(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Rows without exact repeats of an id, its label and its vector; these always lie in one block."""
    order = np.lexsort((labels, ids))
    if not (ids[order][1:] == ids[order][:-1]).any():
        return np.arange(len(ids))
    return np.sort(np.unique(np.column_stack([ids, labels, vectors]), axis=0, return_index=True)[1])


def _loaded(rows: pa.Table, anchors: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    wanted, vectors = matrix(anchors["v"]), matrix(rows["v"])
    width = max(wanted.shape[1], vectors.shape[1])
    wider = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
    wanted, vectors = wider(wanted), wider(vectors)
    ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
    keep = _distinct(ids, labels, vectors)
    return ids[keep], labels[keep], vectors[keep], anchors["id"].to_numpy(), anchors["label"].to_numpy(), wanted


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, cols, strict=True)})


def _positives(k: int):
    """The block's k best rows of each anchor's label."""

    def find(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        names = ["anchor_id", "positive_id", "positive_score"]
        if rows.num_rows and anchors.num_rows:
            ids, labels, vectors, anchor_ids, anchor_labels, wanted = _loaded(rows, anchors)
            for label in np.unique(anchor_labels):
                own, asks = np.flatnonzero(labels == label), np.flatnonzero(anchor_labels == label)
                if not len(own):
                    continue
                block, own_ids = Block(vectors[own]), ids[own]
                # The longest rows first give each anchor a score that its k best reach at least.
                first = np.argsort(-block.lengths, kind="stable")[: max(FIRST_ROWS, k + 1)]
                begun = block.scores(first, wanted[asks])
                least = []
                for j, a in enumerate(asks.tolist()):
                    other = np.sort(begun[own_ids[first] != anchor_ids[a], j])
                    least.append(int(other[-k]) if len(other) >= k else 0)
                for j, found, scores in block.reached(wanted[asks], least):
                    a = asks[j]
                    other = own_ids[found] != anchor_ids[a]
                    got, scores = own_ids[found[other]], scores[other]
                    best = np.lexsort((got, -scores))[:k]
                    out += zip([int(anchor_ids[a])] * len(best), got[best].tolist(), scores[best].tolist(), strict=True)
        return _table(out, names)

    return find


def _negatives(k: int, low: int):
    """The block's k best rows of other labels for each anchor and positive, within the positive's range of scores."""

    def find(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        if rows.num_rows and anchors.num_rows:
            ids, labels, vectors, anchor_ids, anchor_labels, wanted = _loaded(rows, anchors)
            block, pairs = Block(vectors), anchors["positives"].to_pylist()
            bounds = [[(p["id"], p["score"], -((-low * p["score"]) // 100)) for p in x] for x in pairs]
            for a, found, scores in block.reached(wanted, [min(b[2] for b in x) for x in bounds]):
                high, least = max(b[1] for b in bounds[a]), min(b[2] for b in bounds[a])
                fits = (scores >= least) & (scores <= high) & (labels[found] != anchor_labels[a]) & (ids[found] != anchor_ids[a])
                got, scores = ids[found[fits]], scores[fits]
                order = np.lexsort((got, -scores))
                got, scores = got[order], scores[order]
                for positive, most, lowest in bounds[a]:
                    begin, end = np.searchsorted(-scores, [-most, -lowest + 1])
                    for j in range(begin, min(end, begin + k)):
                        out.append((int(anchor_ids[a]), positive, most, int(got[j]), int(scores[j])))
        return _table(out, names)

    return find


def mine(df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of the ``anchors``.

    A score is the product of the vectors of floor(256 * x). The positives of an anchor are the best other rows of its
    label; the negatives of a positive are the best rows of other labels whose score is at most the positive's and at
    least ``low`` percent of it. Ties go to the smaller id; fewer are given where there are no more.

    Rows without id, label or vector, with a component that is null or not finite, or with a vector of 2**30 or longer
    (as scaled) take no part. Vectors shorter than others end in zeros, so that an empty one scores 0. Equal rows count
    once; rows of one id that differ each count, none of them against their own id, and the least by label and vector is
    the anchor. An empty table gives no rows; columns other than those named are left out.
    """
    rows = usable(df, id_col, vector_col, label_col)
    chosen = usable(df.filter(anchors), id_col, vector_col, label_col).groupBy("id").agg(F.min(F.struct("label", "v", "length")).alias("a")).select("id", "a.*")
    chosen = stored(chosen, "anchors")
    parts = max(1, -(-chosen.count() // ANCHORS))
    chosen = chosen.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    # Lengths from 1 to 2**30 give 122 buckets at most.
    sizes = [(r["bucket"], -(-r["n"] // ROWS), r["longest"]) for r in rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).collect()]
    if not sizes:
        sizes = [(-1, 1, 0.0)]
    places = F.array(*(F.struct(F.lit(b).alias("bucket"), F.lit(n).alias("blocks"), F.lit(float(x)).alias("longest")) for b, n, x in sorted(sizes)))
    blocks = F.lit(1)
    for b, n, _ in sizes:
        blocks = F.when(F.col("bucket") == b, n).otherwise(blocks)
    key = ["bucket", "block", "part"]
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(*key, "id", "label", "v")

    def met(asks: DataFrame, reach: Column | None = None) -> DataFrame:
        """The anchors for each block of the buckets whose longest vector reaches a score with them."""
        fits = places if reach is None else F.filter(places, lambda p: p["longest"] * F.col("length") * (1 + _MARGIN) >= reach)
        out = asks.withColumn("p", F.explode(fits)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("p.blocks") - 1)))
        return out.withColumn("bucket", F.col("p.bucket")).drop("p", "length")

    near = dealt.groupBy(*key).cogroup(met(chosen).groupBy(*key)).applyInArrow(_positives(positives), "anchor_id long, positive_id long, positive_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    best = stored(near.withColumn("r", rank).filter(F.col("r") <= positives).drop("r"), "positives")
    # A positive below zero has no score between a share of it and itself.
    own = best.filter("positive_score >= 0").groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
    asks = chosen.join(own, "id")
    least = F.array_min(F.transform("positives", lambda p: p["score"])).cast("double") * low / 100
    hard = dealt.groupBy(*key).cogroup(met(asks, least).groupBy(*key)).applyInArrow(_negatives(negatives, low), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    return hard.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
