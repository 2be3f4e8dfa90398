"""Shared pieces of the training-data operators: shared-folder tables and vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes hashed at once; bounds the working arrays at about 50 bytes for each byte of text.
BLOCK_BYTES = 1 << 20
_PRIME = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a local session that names none gets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as zstd Parquet into the shared folder and read it again; removed when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def tidy(work):
    """``work`` of mapInArrow that gives freed memory back when a task ends: its worker goes on to the next stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the prime and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 1)
        for key, base in (("up", _PRIME), ("down", pow(_PRIME, -1, 1 << 64))):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[key] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (first, last + 1, bytes, offsets) with at most ``size`` bytes, one row at least."""
    data, offsets = buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a block of texts, as places and 64-bit hashes of their A-Z-lowered bytes.

    ``starts``/``ends`` are byte places in the block, ``first[d]:first[d + 1]`` the words of text d.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None, fold: bool = True):
        """keep: bytes to leave out of the hashed words (True: part of a word); all but white space by default. fold: hash A-Z as a-z."""
        n = len(data)
        word = ~_SPACE[data] if keep is None else keep[data]
        begins = np.zeros(n + 1, dtype=bool)
        begins[offsets] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = word[:-1]
        after = np.append(word[1:], False) if n else before
        self.starts = np.flatnonzero(word & (~before | begins[:-1]))
        self.ends = np.flatnonzero(word & (~after | begins[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(((_LOWER[data] if fold else data).astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


_STEPS = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, dtype=np.uint64), dtype=np.uint64)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hashes of all runs of n successive values."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out += hashes[k : k + m] * _STEPS[k]
    return mix(out + np.uint64(n))


def bitmap(keys: DataFrame, bits_each: int = 16, most_bits: int = 1 << 28) -> bytes:
    """A bitmap of the places of the distinct longs in the column ``key``; its size follows from their number, up to ``most_bits``.

    It holds every key, and others by chance: a sixteenth of them, more where the size is at its bound.
    """
    seen = stored(keys.select("key"), "keys")
    size = min(most_bits, max(1 << 18, 1 << (seen.count() * bits_each).bit_length()))
    bit = F.pmod("key", F.lit(size))
    rows = seen.select(F.floor(bit / 32768).cast("int").alias("bucket"), F.pmod(bit, F.lit(32768)).alias("bit")).groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).toLocalIterator()
    out = bytearray(size // 8)
    for r in rows:
        out[r["bucket"] * 4096 : r["bucket"] * 4096 + 4096] = r["bits"]
    return bytes(out)


def held(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Which of the keys a ``bitmap`` holds."""
    table = np.frombuffer(bits, dtype=np.uint8)
    place = (keys.astype(np.uint64) & np.uint64(8 * len(table) - 1)).astype(np.int64)
    return (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def list_of(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column whose rows hold the next ``sizes`` values."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column whose rows hold the bytes of the next ``sizes`` values."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes * values.dtype.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def flat_values(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all values, bounds of the rows among them) of a column of ``binaries``."""
    data, offsets = buffers(column)
    return np.frombuffer(data.tobytes(), dtype=kind), offsets // kind.itemsize
