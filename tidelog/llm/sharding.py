"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots, the bytes of each slot are summed, and a stored,
versioned slot-to-shard map says where each slot lives. The map alone is edited when shards are added,
removed or become uneven, so that a record moves only if its slot does.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidelog.llm.common import remove_at_exit, shared_folder, stored

#: Virtual slots. Fixed for the life of a data set; a map has this many rows whatever the data's size.
SLOTS = 8192
RUN = 4096
ROW_OVERHEAD = 8
MAP_SCHEMA = T.StructType([T.StructField("version", T.LongType()), T.StructField("virtual_slot", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("bytes", T.LongType())])


def slotted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, virtual_slot) of each record.

    Null texts weigh ROW_OVERHEAD bytes and share the CRC of the empty text; a null id is hashed like any
    other value. The text takes part in the hash, and for repeated rows their running number, so that equal
    rows spread too: they are counted, and made again from the counts, some RUN of them at a time.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(id_col), text).alias("hash"),
        F.xxhash64(F.lit(1), text, F.col(id_col)).alias("hash2"),
    )
    copies = rows.groupBy("doc_id", "size", "text_crc32", "hash", "hash2").agg(F.count(F.lit(1)).alias("n"))
    runs = copies.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1).cast("long"), F.lit(RUN).cast("long"))))
    each = runs.withColumn("copy", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN, F.col("n")) - 1)))
    hash_ = F.when(F.col("copy") == 0, F.col("hash")).otherwise(F.xxhash64("hash", "hash2", "copy"))
    return each.select("doc_id", "size", "text_crc32", F.pmod(hash_, F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_loads(records: DataFrame) -> DataFrame:
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def balanced(loads: dict[int, int], shards: int, slots: int) -> dict[int, int]:
    """A first map: slots, heaviest first, each to the lightest shard so far. Empty slots are dealt in turn."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda s: (-loads.get(s, 0), s)):
        weight, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (weight + max(loads.get(slot, 0), 1), shard))
    return out


def rebalanced(placed: dict[int, int], loads: dict[int, int], shards: int) -> dict[int, int]:
    """An edited map for ``shards`` shards that moves few slots.

    Slots of removed shards go to the lightest shards; then slots move from the heaviest to the lightest
    shard as long as a move narrows the gap between the two. With added shards, slots move to these alone.
    """
    out = dict(placed)
    weight = dict.fromkeys(range(shards), 0)
    for slot, shard in out.items():
        if shard < shards:
            weight[shard] += loads.get(slot, 0)
    for slot in sorted((s for s, shard in out.items() if shard >= shards), key=lambda s: (-loads.get(s, 0), s)):
        out[slot] = min(weight, key=lambda s: (weight[s], s))
        weight[out[slot]] += loads.get(slot, 0)
    held: dict[int, list[tuple[int, int]]] = {s: [] for s in range(shards)}
    for slot, shard in out.items():
        held[shard].append((loads.get(slot, 0), slot))
    for x in held.values():
        x.sort()
    takers = [s for s in range(shards) if not held[s]] or list(range(shards))  # added shards alone, if there are any
    for _ in range(len(out) * 2):
        low, high = min(takers, key=lambda s: (weight[s], s)), max(weight, key=lambda s: (weight[s], -s))
        gap = weight[high] - weight[low]
        fits = [x for x in held[high] if 0 < x[0] < gap]
        if not fits:
            break
        best = min(fits, key=lambda x: (abs(gap - 2 * x[0]), x[1]))
        if abs(gap - 2 * best[0]) >= gap:
            break
        held[high].remove(best)
        held[low].append(best)
        weight[high] -= best[0]
        weight[low] += best[0]
        out[best[1]] = low
    return out


def slot_map(spark: SparkSession, placed: dict[int, int], loads: dict[int, int], version: int) -> DataFrame:
    return spark.createDataFrame([(version, slot, shard, loads.get(slot, 0)) for slot, shard in sorted(placed.items())], MAP_SCHEMA)


def save_map(table: DataFrame, path: str) -> None:
    """Add one version of the map under ``path``; versions stay side by side and can be read again."""
    table.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    newest = F.lit(version) if version is not None else F.lit(table.agg(F.max("version")).first()[0])
    return table.filter(F.col("version") == newest)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def collected(loads: DataFrame) -> dict[int, int]:
    """Bytes by slot on the driver: at most as many rows as there are virtual slots."""
    return {r["virtual_slot"]: r["bytes"] for r in loads.select("virtual_slot", "bytes").collect()}


def shard(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Place every record: (doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version).

    Law ``bytes``: shards hold nearly equal bytes; ``slot`` counts the records of a shard from 0 without gaps
    (by virtual slot, then id, CRC and size); ``grown_shard`` is null under this law. An empty table gives no
    rows. Equal rows take successive slots in any order. If ``map_path`` is given, the newest map there is
    kept and edited, or the first version made there; otherwise it is made in the shared folder.
    """
    spark = df.sparkSession
    records = stored(slotted(df, id_col, text_col, slots), "records")
    table = slot_loads(records)
    counts = {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in table.collect()}
    loads = {k: v[0] for k, v in counts.items()}
    path, version, placed = map_path, 1, None
    old = load_map(spark, path).collect() if path and _exists(spark, path) else []
    if old:
        placed, version = rebalanced({r["virtual_slot"]: r["shard"] for r in old}, loads, shards), old[0]["version"] + 1
    else:
        placed = balanced(loads, shards, slots)
    if not path:
        path = f"{shared_folder(spark)}/slot_map"
        remove_at_exit(spark, path)
    save_map(slot_map(spark, placed, loads, version), path)
    after, begins = dict.fromkeys(range(shards), 0), {}
    for slot in range(slots):
        begins[slot] = after[placed[slot]]
        after[placed[slot]] += counts.get(slot, (0, 0))[1]
    places = load_map(spark, path, version).join(F.broadcast(spark.createDataFrame(list(begins.items()), "virtual_slot int, begins long")), "virtual_slot")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.join(F.broadcast(places.select("virtual_slot", "shard", "begins", F.col("version").alias("map_version"))), "virtual_slot")
        .withColumn("slot", F.col("begins") + F.row_number().over(order) - 1)
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
    )
