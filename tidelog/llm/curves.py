"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are scaled to length one, turned by a random rotation, cut to a few coordinates, shifted, and put in
the order of a Hilbert curve; this is done for several rotations. In each order, Spark range-partitions the keys and
every query is compared with the rows within a window of positions around it, which grows with the table. The curves carry
ids and vectors of a byte a component; the windows' best rows of all curves are merged, and the vectors themselves are
fetched once, for the best of these, which are ranked by their exact cosine.

Equal vectors are one point on the curves, so that copies can't fill a window; their ids come back at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import binaries, stored

#: Orders, coordinates on each curve, bits of a coordinate.
CURVES, COORDINATES, BITS = 24, 16, 3
#: Positions compared in one task group, at least and at most; scores held at once.
BLOCK, MOST_BLOCK, SCORES = 2048, 1 << 15, 1 << 19


#: Rows kept by their byte vectors for each row asked for, before the exact ranking.
SPARE = 4


def reach(rows: int, k: int) -> int:
    """Positions compared on each side of a query.

    Over vectors without structure, the distance on the best of the curves within which 95 % of the nearest rows
    stand grows a little less than the table; this power stays above it from 500 to 500,000 rows.
    """
    return max(4 * k, math.ceil(rows**0.9 / 17))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells [n, d] with ``bits`` bits a coordinate; d * bits is 63 at most.

    From the highest bit down, the orientation of the subcube is undone by swaps and reflections of the
    coordinates; the Gray code of what is left is decoded, and the bits are interleaved.
    """
    n, d = cells.shape
    x = [cells[:, k].astype(np.int64) for k in range(d)]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for k in range(d):
            flip = (x[k] >> bit & 1).astype(bool)
            swap = np.where(flip, 0, (x[0] ^ x[k]) & low)
            x[k] = x[k] ^ swap  # nothing for k = 0
            x[0] = x[0] ^ np.where(flip, low, swap)
    for k in range(1, d):
        x[k] ^= x[k - 1]
    turn = np.zeros(n, np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    key = np.zeros(n, np.int64)
    for bit in range(bits - 1, -1, -1):
        for k in range(d):
            key = key << 1 | ((x[k] ^ turn) >> bit & 1)
    return key


def rotation(dim: int, curve: int, coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions [dim, coordinates] and shifts, in spreads, of a curve."""
    rng = np.random.default_rng((20240501, curve, dim))
    q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    return q[:, : min(coordinates, dim)], rng.uniform(-0.5, 0.5, min(coordinates, dim))


def curve_keys(unit: np.ndarray, curve: int) -> np.ndarray:
    """Keys of unit vectors on one curve. A coordinate's spread is that of random directions, 1 / sqrt(dim)."""
    turn, shift = rotation(unit.shape[1], curve, COORDINATES)
    y = unit @ turn * np.sqrt(unit.shape[1]) + shift
    return hilbert_keys(np.clip((y / 3 + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)


def _packed(vector: str, dim: int):
    """(vec_id, packed) of the rows that can take part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            size = pa.compute.list_value_length(column)
            keep = pa.compute.fill_null(pa.compute.and_(pa.compute.equal(size, dim), batch.column("vec_id").is_valid()), False)
            batch = batch.filter(keep)
            flat = batch.column("vector").flatten()
            x = flat.to_numpy(zero_copy_only=False).astype("<f4" if pa.types.is_float32(flat.type) else "<f8").reshape(-1, dim)
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            rows = pa.array([r.tobytes() for r in x[good]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(good)), rows], names=["vec_id", "packed"])

    return pack


def _matrix(packed: pa.Array, dim: int) -> np.ndarray:
    """Vectors of a column whose rows are all floats or all doubles."""
    data = b"".join(packed.to_pylist())
    kind = "<f4" if len(packed) and len(data) == 4 * dim * len(packed) else "<f8"
    return np.frombuffer(data, dtype=kind).reshape(-1, dim).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small numbers stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keyed(dim: int):
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column("packed"), dim))
            codes = binaries(np.rint(unit * (127 / np.abs(unit).max(axis=1, keepdims=True, initial=0))).astype(np.int8), np.full(len(unit), dim)) if len(unit) else pa.array([], pa.binary())
            for curve in range(CURVES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), curve, np.int32)), pa.array(curve_keys(unit, curve)), batch.column("id"), batch.column("asks"), codes], names=["curve", "key", "id", "asks", "codes"])

    return key


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        place = np.arange(n, n + batch.num_rows)
        n += batch.num_rows
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("curve", "id", "asks", "codes")), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(place)], names=["curve", "id", "asks", "codes", "part", "place"])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[a, b] cosines in double precision."""
    a, b = _scaled(a), _scaled(b)
    return a @ b.T / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which change no digit, so that squares of very large or small numbers stay finite."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


def _exact(dim: int):
    """The cosine of each pair of vectors."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_scaled(_matrix(batch.column(c), dim)) for c in ("asked", "packed"))
            score = (a * b).sum(axis=1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("id"), pa.array(score, pa.float64())], names=["query", "id", "score"])

    return exact


def _ranked(dim: int, k: int, within: int):
    """Each query's best rows, by their byte vectors, within its window in one block."""

    def rank(table: pa.Table) -> pa.Table:
        asks = table["role"].to_numpy() == 1
        ids, pos = table["id"].to_numpy(), table["pos"].to_numpy()
        x = np.frombuffer(b"".join(table["codes"].to_pylist()), dtype=np.int8).reshape(-1, dim).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        for rows in np.array_split(q, max(1, len(q) * len(c) // SCORES)):
            if not len(rows) or not len(c):
                continue
            score = x[rows] @ x[c].T
            score[(np.abs(pos[rows][:, None] - pos[c]) > within) | (ids[rows][:, None] == ids[c])] = -np.inf
            most = min(k, len(c))
            order = np.argpartition(-score, most - 1, axis=1)[:, :most]
            best = np.take_along_axis(score, order, axis=1)
            good = np.isfinite(best)
            out.append((np.repeat(ids[rows], good.sum(axis=1)), ids[c][order[good]], best[good]))
        return pa.table({n: np.concatenate(v) for n, v in zip(("query", "id", "score"), zip(*out, strict=True), strict=True)})

    return rank


def search(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row whose id is divisible by ``every``.

    Nearness is the cosine in double precision, ties go to the smaller id. Rows without an id, vectors that are null, zero, or
    hold null or non-finite values, and vectors not of the table's commonest length take no part. Repeated rows
    count once; all rows of a query's own id are left out of its list. Empty tables give no rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    length = rows.filter("size(vector) > 0").groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = length["n"] if length else 1
    members = stored(rows.mapInArrow(_packed("vector", dim), "vec_id long, packed binary"), "members")
    asks = F.pmod("vec_id", F.lit(every)) == 0
    classes = stored(members.groupBy("packed").agg(F.min("vec_id").alias("id"), F.max(asks).alias("asks")), "classes")
    curves = classes.mapInArrow(_keyed(dim), "curve int, key long, id long, asks boolean, codes binary")
    ordered = curves.repartitionByRange("curve", "key", "id").sortWithinPartitions("curve", "key", "id")
    ordered = stored(ordered.mapInArrow(_numbered, "curve int, id long, asks boolean, codes binary, part int, place long"), "ordered")
    counts = sorted((r["part"], r["n"]) for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    total = sum(n for _, n in counts) // CURVES
    begins, seen = [], 0
    for part, n in counts:
        begins.append((part, seen))
        seen += n
    placed = ordered.join(F.broadcast(spark.createDataFrame(begins, "part int, begins long")), "part")
    placed = placed.withColumn("pos", F.col("begins") + F.col("place") - F.col("curve").cast("long") * F.lit(total))
    within = reach(total, k)
    size = min(max(BLOCK, within // 4), MOST_BLOCK)
    block = lambda c: F.floor(c / size)
    rest = ["curve", "pos", "id", "codes"]
    near = placed.select(block(F.col("pos")).alias("block"), F.lit(0).alias("role"), *rest)
    last = block(F.lit(max(total - 1, 0)))
    span = F.sequence(block(F.greatest(F.col("pos") - within, F.lit(0))), F.least(block(F.col("pos") + within), last))
    asking = placed.filter("asks").select(F.explode(span).alias("block"), F.lit(1).alias("role"), *rest)
    found = near.union(asking).groupBy("curve", "block").applyInArrow(_ranked(dim, SPARE * k, within), "query long, id long, score float")
    merged = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    merged = merged.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= SPARE * k).select("query", "id")
    merged = merged.union(classes.filter("asks").select(F.col("id").alias("query"), "id"))  # copies of a query's own vector
    vectors = classes.select("id", "packed")
    merged = merged.join(vectors.select(F.col("id").alias("query"), F.col("packed").alias("asked")), "query").join(vectors, "id")
    merged = merged.select("query", "id", "asked", "packed").mapInArrow(_exact(dim), "query long, id long, score double")
    merged = stored(merged, "merged")
    # Back from classes to rows: the smallest ids of each class are enough for a list of k.
    of = members.join(classes.select("packed", "id"), "packed").select("id", "vec_id").distinct()
    few = of.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).filter(F.col("r") <= k + 1).select("id", "vec_id")
    lists = merged.join(few, "id").select("query", "vec_id", "score")
    top = lists.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1)
    queries = of.filter(asks).select(F.col("id").alias("query"), F.col("vec_id").alias("query_id"))
    final = queries.join(top.select("query", "vec_id", "score"), "query").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return final.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
