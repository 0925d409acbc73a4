"""Sharding over fixed virtual slots.

Every record hashes into one of ``SLOTS`` virtual slots, a number that never changes. Rows and bytes
are aggregated per slot. A versioned map, stored as a table, gives each slot a shard; it is never
changed in place: rebalancing reads a version, edits it and stores the next one. For one more shard
the edit takes an equal share of slots from the others and moves nothing else, and version n is a
pure function of n, so a record's shard depends on its id and on the shard count only. ``rebalance``
is the other edit: it evens out the slots' bytes, where that is worth more than this law.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch

SLOTS = 8192
#: Groups that a virtual slot's rows are numbered in, so that one id with very many rows is not one task.
PARTS = 8


def slot_map(n_shards: int, slots: int = SLOTS) -> list[int]:
    """Version ``n_shards`` of the map: the shard of each slot."""
    if n_shards < 1 or n_shards > slots:
        raise ValueError("the number of shards must be between 1 and the number of slots")
    shard_of = [0] * slots
    for new in range(1, n_shards):
        shard_of = grow(shard_of, new)
    return shard_of


def grow(shard_of: list[int], new: int) -> list[int]:
    """The next version: shard ``new`` takes its share, slot by slot from the shard that has most slots."""
    out = list(shard_of)
    own: dict[int, list[int]] = {}
    for slot, shard in enumerate(out):
        own.setdefault(shard, []).append(slot)
    heap = [(-len(v), shard) for shard, v in own.items()]
    heapq.heapify(heap)
    for _ in range(len(out) // (new + 1)):
        n, shard = heapq.heappop(heap)
        out[own[shard].pop()] = new
        heapq.heappush(heap, (n + 1, shard))
    return out


def rebalance(shard_of: list[int], slot_bytes: dict[int, int], tolerance: float = 0.02) -> list[int]:
    """Edit a map so that shards' bytes are near equal, moving few slots: largest fitting slots go from the fullest shard to the emptiest."""
    out = list(shard_of)
    size = dict.fromkeys(out, 0)
    for slot, shard in enumerate(out):
        size[shard] += slot_bytes.get(slot, 0)
    mean = sum(size.values()) / len(size)
    for _ in range(len(out)):
        full, empty = max(size, key=lambda s: (size[s], -s)), min(size, key=lambda s: (size[s], s))
        gap = size[full] - size[empty]
        if size[full] <= mean * (1 + tolerance):
            break
        fits = [(slot_bytes.get(s, 0), -s) for s, x in enumerate(out) if x == full and 0 < slot_bytes.get(s, 0) < gap]
        if not fits:
            break
        half = [x for x in fits if x[0] <= gap / 2]
        n, slot = max(half) if half else min(fits)
        out[-slot] = empty
        size[full] -= n
        size[empty] += n
    return out


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """A null key hashes like any other value, to one fixed slot."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def store_map(spark: SparkSession, path: str, version: int, shard_of: list[int]) -> None:
    """Store a version of a map; versions are never overwritten, so old placements can be looked up."""
    rows = [(slot, shard) for slot, shard in enumerate(shard_of)]
    spark.createDataFrame(rows, "virtual_slot int, shard int").coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]]:
    """A stored version, or the latest, and its map: one row a slot."""
    stored = spark.read.parquet(path)
    version = stored.agg(F.max("version")).first()[0] if version is None else version
    return version, [r["shard"] for r in stored.where(F.col("version") == version).orderBy("virtual_slot").collect()]


def stored_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    """A stored version as it is: virtual_slot, shard."""
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}")


def slot_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Rows and bytes of each virtual slot that has rows; at most ``slots`` rows."""
    return docs.groupBy(virtual_slot(F.col(id_col), slots).alias("virtual_slot")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(size_of(F.col(text_col))).alias("n_bytes"))


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Shard and place of every row.

    Columns: the id, size, text_crc32, virtual_slot, shard, slot (place within the shard, without
    gaps from 0), grown_shard (with one more shard), slot_bytes and shard_bytes (of the row's virtual
    slot and of its shard). The map's version ``n_shards`` is stored, read back, edited for one more
    shard and stored again; both shards come from the stored versions.

    Null ids share one virtual slot; a null text has size 1 and the crc of no bytes. Repeated rows
    keep separate places. An empty table gives an empty result. Other columns are ignored, whatever
    their names.

    Only ids, sizes and checksums are shuffled, never texts. Places come from a count per
    (virtual slot, part): ``slots * PARTS`` rows at most, whatever the input, so joining those
    back by broadcast is bounded; rows are numbered within such a small group only.
    """
    spark = docs.sparkSession
    path = f"{Scratch(spark, 'sharding').path}/map"
    store_map(spark, path, n_shards, slot_map(n_shards, slots))
    store_map(spark, path, n_shards + 1, grow(load_map(spark, path, n_shards)[1], n_shards))
    both = stored_map(spark, path, n_shards).join(stored_map(spark, path, n_shards + 1).withColumnRenamed("shard", "grown_shard"), "virtual_slot")
    rows = docs.select(
        F.col(id_col).alias("id"),
        size_of(F.col(text_col)).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        virtual_slot(F.col(id_col), slots).alias("virtual_slot"),
    ).withColumn("part", F.pmod(F.xxhash64("text_crc32", "size"), F.lit(PARTS)).cast("int"))
    counts = rows.groupBy("virtual_slot", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(F.broadcast(both), "virtual_slot").select(
        "virtual_slot",
        "part",
        "shard",
        "grown_shard",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
        F.sum("bytes").over(Window.partitionBy("virtual_slot")).alias("slot_bytes"),
        F.sum("bytes").over(Window.partitionBy("shard")).alias("shard_bytes"),
    )
    place = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("id", "text_crc32", "size"))
    return (
        rows.withColumn("place", place)
        .join(F.broadcast(starts), ["virtual_slot", "part"])
        .select(F.col("id").alias(id_col), "size", "text_crc32", "virtual_slot", "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard", "slot_bytes", "shard_bytes")
    )
