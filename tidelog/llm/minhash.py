"""MinHash near-duplicate groups with sequential Bayesian verification.

1. Every text becomes its set of distinct word 5-grams, a digest of that set and a MinHash signature; texts
   of equal sets form one class, and all later steps work on classes.
2. Bands of signature values name buckets. In each bucket every class is paired with the bucket's smallest
   class, so the number of candidates is linear in the number of classes.
3. Candidates are verified batch by batch of signature values: with m of n values equal, a pair is pruned
   once the posterior probability that its similarity reaches the threshold falls under the miss probability.
   Survivors are decided on the full sets.
4. The links give components. Buckets that still hold classes of several components are compared in full,
   between components, in blocks, by the same looks and the full sets; each block gives no more links than join
   its components. Blocks of the bucket's largest component meet those of the others alone, so that a large group
   of copies with a few stragglers takes work in proportion to its size. Of buckets with the same members, one is
   compared. The components are taken again then.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Words, blocks, grams, long_array, stored, tidy
from tidelog.llm.graph import components

SHINGLE = 5
#: 24 bands of 5 values: a pair at similarity 0.85 shares no bucket with probability 8e-7.
BANDS, ROWS = 24, 5
VALUES = BANDS * ROWS
#: Values compared before each look at the posterior.
BATCH = 15
#: Posterior probability of a similarity at the threshold under which a pair is pruned.
MISS = 1e-7
#: Classes in one block of a comparison within a mixed bucket, and bytes of their compressed texts.
BLOCK, BLOCK_BYTES = 256, 4 << 20
_random = np.random.default_rng(20240101)
_FLIP = _random.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _random.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than SHINGLE words make one shingle, none an empty set."""
    words = Words(data, offsets)
    runs = grams(words.hashes, SHINGLE)
    out = []
    for first, last in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        n = last - first
        if n >= SHINGLE:
            x = np.sort(runs[first : last - SHINGLE + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        else:
            out.append(grams(words.hashes[first:last], n) if n else np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """VALUES MinHash values, 16 bits of each."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), 2048):
        part = (shingles[None, k : k + 2048] ^ _FLIP[:, None]) * _MULTIPLY[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return ((low >> np.uint64(33)) & np.uint64(0xFFFF)).astype("<u2")


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in blocks(batch.column("text")):
            sets = shingle_sets(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id")[first:last],
                    batch.column("text_hash")[first:last],
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([set_digest(x) if len(x) else None for x in sets], pa.binary()),
                    pa.array([signature(x).tobytes() if len(x) else None for x in sets], pa.binary()),
                ],
                names=["doc_id", "text_hash", "n_shingles", "digest", "sig"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = _band_keys(np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype="<u2"))
        yield pa.RecordBatch.from_arrays([long_array(keys.ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys))), pa.array(np.repeat(batch.column("id").to_numpy(), BANDS))], names=["bucket", "band", "id"])


@cache
def least_matches(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(values compared, fewest equal ones to go on) of each look.

    The prior of the similarity is uniform, so that after m of n equal values the posterior is Beta(m + 1, n - m + 1),
    whose tail above the threshold is the binomial sum P(X <= m) for n + 1 draws at the threshold.
    """
    out = []
    for n in [*range(BATCH, VALUES, BATCH), VALUES]:
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Rows of the signature pairs that no look prunes."""
    alive, equal, done = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in least_matches(threshold):
        equal = equal + (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
        going = equal >= least
        alive, equal, done = alive[going], equal[going], n
        if not len(alive):
            break
    return alive


def _pruned(threshold: float):
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<u2").reshape(-1, VALUES) for k in ("sig_u", "sig_v"))
                keep = pa.array(survivors(a, b, threshold))
                yield pa.RecordBatch.from_arrays([batch.column("u").take(keep), batch.column("v").take(keep)], names=["u", "v"])

    return prune


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compress the texts that have their class's set; another text under the same id is left out."""
    pack = zstandard.ZstdCompressor(3)
    for batch in batches:
        for first, last, data, offsets in blocks(batch.column("text")):
            wanted = batch.column("digest")[first:last].to_pylist()
            keep = [k for k, x in enumerate(shingle_sets(data, offsets)) if len(x) and set_digest(x) == wanted[k]]
            whole = data.tobytes()
            packed = [pack.compress(whole[offsets[k] : offsets[k + 1]]) for k in keep]
            at = pa.array([first + k for k in keep], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("digest").take(at), pa.array(packed, pa.binary())], names=["id", "digest", "packed"])


def _exact(percent: int):
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        last: dict[str, tuple[bytes, np.ndarray]] = {}

        def shingles(side: str, digest: bytes, packed: bytes) -> np.ndarray:
            if side not in last or last[side][0] != digest:  # a side's pairs often follow one another
                text = np.frombuffer(unpack.decompress(packed), dtype=np.uint8)
                last[side] = (digest, shingle_sets(text, np.array([0, len(text)]))[0])
            return last[side][1]

        for batch in batches:
            keep = []
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("digest_u", "packed_u", "digest_v", "packed_v")), strict=True)):
                a, b = shingles("u", *row[:2]), shingles("v", *row[2:])
                if _linked(a, b, percent):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column("u").take(pa.array(keep, pa.int64())), batch.column("v").take(pa.array(keep, pa.int64()))], names=["u", "v"])

    return decide


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The (u, v) pairs of classes whose full sets reach the threshold."""
    named = lambda side: [F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("sig",))]
    pruned = pairs.join(classes.select(*named("u")), "u").join(classes.select(*named("v")), "v").select("u", "v", "sig_u", "sig_v").mapInArrow(tidy(_pruned(percent / 100)), "u long, v long")
    pruned = stored(pruned, "pairs")
    packed = _texts_of(pruned.select(F.col("u").alias("id")).union(pruned.select(F.col("v").alias("id"))), classes, texts)
    side = lambda s: packed.select(F.col("id").alias(s), F.col("digest").alias(f"digest_{s}"), F.col("packed").alias(f"packed_{s}"))
    return stored(pruned.join(side("u"), "u").join(side("v"), "v").mapInArrow(tidy(_exact(percent)), "u long, v long").distinct(), "links")


def _band_keys(sig: np.ndarray) -> np.ndarray:
    """Bucket keys [signature, band]."""
    weights = np.cumprod(np.full(ROWS, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)
    salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    keys = ((sig.reshape(-1, BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * weights).sum(axis=2, dtype=np.uint64) + salt
    keys ^= keys >> np.uint64(31)
    return keys * np.uint64(0xBF58476D1CE4E5B9)


def _crossing(percent: int):
    """Links between different components in two blocks of a bucket, no more than join them.

    A pair that shares several buckets is looked at in the first of them, and one whose components have met in
    this group by then is left out.
    """

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        bucket, one_block = np.int64(key[0].as_py()).astype(np.uint64), key[1].as_py() == key[2].as_py()
        side, ids, labels = (table[c].to_numpy() for c in ("side", "id", "label"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), dtype="<u2").reshape(-1, VALUES)
        bands, packed, sets = _band_keys(sig), table["packed"], {}
        unpack, roots = zstandard.ZstdDecompressor(), {}

        def root(x: int) -> int:
            while roots.get(x, x) != x:
                x = roots[x] = roots.get(roots[x], roots[x])
            return x

        def shingles(k: int) -> np.ndarray:
            if k not in sets:
                text = np.frombuffer(unpack.decompress(packed[k].as_py()), dtype=np.uint8)
                sets[k] = shingle_sets(text, np.array([0, len(text)]))[0]
            return sets[k]

        u, v = [], []
        right = np.arange(len(ids)) if one_block else np.flatnonzero(side == 1)
        for k in range(len(ids)) if one_block else np.flatnonzero(side == 0).tolist():
            other = right[(labels[right] != labels[k]) & ((ids[right] > ids[k]) if one_block else True)]
            if not len(other):
                continue
            other = other[survivors(np.broadcast_to(sig[k], (len(other), VALUES)), sig[other], percent / 100)]
            same = bands[other] == bands[k]
            for j in other[bands[k, same.argmax(axis=1)] == bucket].tolist():
                mine, its = root(int(labels[k])), root(int(labels[j]))
                if mine != its and _linked(shingles(k), shingles(j), percent):
                    roots[mine] = its
                    u.append(max(ids[k], ids[j]))
                    v.append(min(ids[k], ids[j]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return compare


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # two sorted runs: a merge
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * same >= percent * (len(both) - same)


def _texts_of(needed: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, digest, packed): the compressed texts of the classes named by ``needed.id``."""
    wanted = needed.distinct().join(classes.select("id", "digest"), "id")
    return stored(texts.join(wanted, texts.doc_id == wanted.id).select("id", "digest", "text").mapInArrow(tidy(_compressed), "id long, digest binary, packed binary"), "texts")


def _across(bands: DataFrame, classes: DataFrame, labels: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links between classes of different components that share a bucket."""
    of = bands.join(labels, bands.id == labels.node, "left").select("bucket", "band", "id", F.coalesce("label", "id").alias("label"))
    # A row for each mixed bucket. Of those with the same members, the one of the first band sees all of their pairs: a
    # pair is looked at in the first bucket that it shares.
    inside = of.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"), F.min("band").alias("band"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("held"))
    mixed = inside.groupBy("bucket").agg(F.min("band").alias("band"), F.count(F.lit(1)).alias("labels"), F.sum("c").alias("members"), F.max(F.struct("c", "label")).alias("most"), F.sum("held").alias("held")).filter("labels > 1")
    mixed = stored(mixed.groupBy("members", "held").agg(F.min_by(F.struct("bucket", F.col("most.c").alias("within"), F.col("most.label").alias("main")), "band").alias("b")).select("b.*", "members"), "mixed")
    rows = stored(of.join(mixed, "bucket"), "rows")
    packed = stored(_texts_of(rows.select("id"), classes, texts).groupBy("id", "digest").agg(F.first("packed").alias("packed")), "packed")
    rows = rows.join(classes.select("id", "sig"), "id").join(packed.select("id", "packed"), "id")
    # Classes of a bucket's largest component need no comparison with one another: they take the blocks after those
    # of the other classes, and meet these alone. A bucket of a single block stays whole.
    inside, weight = F.col("label") == F.col("main"), F.octet_length("packed")
    bytes_of = rows.groupBy("bucket").agg(F.sum(F.when(inside, weight).otherwise(0)).alias("main_bytes"), F.sum(weight).alias("bytes"))
    rows = rows.join(stored(bytes_of, "bytes"), "bucket")
    whole = (F.col("members") <= BLOCK) & (F.col("bytes") <= BLOCK_BYTES)
    count = lambda c, size: F.greatest(F.ceil(c / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    rows = rows.withColumn("few", F.when(whole, 1).otherwise(count(F.col("members") - F.col("within"), F.col("bytes") - F.col("main_bytes")))).withColumn("many", F.when(whole, 0).otherwise(count(F.col("within"), F.col("main_bytes"))))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    rows = rows.withColumn("block", F.when(inside & ~whole, F.col("few") + place("many")).otherwise(place("few")))
    meets = F.col("few") + F.when(inside, 0).otherwise(F.col("many"))
    pairs = rows.withColumn("other", F.explode(F.sequence(F.lit(0), meets - 1)))
    pairs = pairs.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "label", "sig", "packed")
    tasks = int(bands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(tasks, "bucket", "i", "j").groupBy("bucket", "i", "j").applyInArrow(_crossing(percent), "u long, v long").distinct()


def _grouped(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and (digest, component) of all classes."""
    sketches = stored(docs.mapInArrow(tidy(_sketch), "doc_id long, text_hash long, n_shingles long, digest binary, sig binary"), "sketches")
    known = sketches.filter("doc_id is not null and digest is not null")
    classes = stored(known.groupBy("digest").agg(F.min("doc_id").alias("id"), F.min_by("sig", "doc_id").alias("sig")), "classes")
    bands = stored(classes.select("id", "sig").mapInArrow(tidy(_bands), "bucket long, band int, id long"), "bands")
    # Stored first, so that both sides of the join are plain exchanges, whose large partitions Spark splits.
    leaders = stored(bands.groupBy("bucket").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("members")).filter("members > 1"), "leaders")
    shared = stored(bands.join(leaders, "bucket").select("bucket", "band", "id", "leader"), "shared")
    stars = shared.filter("id <> leader").select(F.col("id").alias("u"), F.col("leader").alias("v")).distinct()
    links = _verified(stars, classes, docs, percent)
    labels = components(links)
    more = stored(_across(shared.select("bucket", "band", "id"), classes, labels, docs, percent), "across")
    if not more.isEmpty():
        labels = components(links.union(more))
    return sketches, stored(classes.join(labels, classes.id == labels.node, "left").select("digest", F.coalesce("label", "id").alias("component")), "components")


def near_duplicates(df: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row.

    Words are runs of non-white-space, A-Z lowered; a text of fewer than five words is one shingle. Null or
    empty texts have no shingles and stand alone. Rows of equal sets share a component, repeated rows too.
    Rows with a null id join no component: component_id is null and kept is true. Ids are taken to name one text
    each, in one row or several; other texts under an id are grouped by their own sets. An empty table gives no rows.
    """
    found = _components(df, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _components(df: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    sketches, of_class = _grouped(docs, percent)
    rows = sketches.select("doc_id", "text_hash", "n_shingles", "digest")
    # Rows without a set or an id are in no class; they are kept out of the join, where they would meet in one task.
    alone = rows.filter("doc_id is null or digest is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    grouped = rows.filter("doc_id is not null and digest is not null").join(of_class, "digest").select("doc_id", "text_hash", "n_shingles", F.col("component").alias("component_id"))
    return grouped.union(alone)


def keep_one(df: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, that stand for their group of near-duplicates.

    The document of the smallest id stays, in one row. Rows are told apart by id and text: a row of another text under
    an id stays or goes by its own group, and both stay if neither has a smaller id in its group. Rows with a null id
    stay as they are.
    """
    groups = _components(df, percent, id_col, text_col).filter("doc_id is not null")
    groups = groups.groupBy("doc_id", "text_hash").agg(F.min("component_id").alias("component"), F.count(F.lit(1)).alias("rows"))
    groups = stored(groups.filter("component <> doc_id or rows > 1"), "groups")
    rows = df.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_hash"))
    named = groups.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    rest = rows.join(named, ["_id", "_hash"], "left_anti").select("_row")
    twice = groups.filter("component = doc_id").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    if not twice.isEmpty():
        first = rows.join(twice, ["_id", "_hash"], "left_semi").groupBy("_id", "_hash").agg(F.first("_row").alias("_row"))
        rest = rest.union(first.select("_row"))
    return rest.select("_row.*")
