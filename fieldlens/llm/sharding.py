"""Sharding by fixed virtual slots.

Every record hashes into one of ``N_SLOTS`` virtual slots, by id and text together, so that neither repeated ids nor repeated texts fill one.  The bytes of each slot are summed over all records; the slots, not
the records, are then placed on shards, the heaviest first on the lightest shard.  The placement is a versioned map with a row
for each slot, which rebalancing edits: it moves slots and leaves the hash alone.  All that reaches the driver is the map
and the sums, a few thousand rows whatever the size of the corpus.

Null text has no bytes; a record weighs ``OVERHEAD`` bytes besides its text.  Rows equal in id
and text share a slot, and their places in it follow the order Spark meets them in.  Empty tables give an all-empty map.
Equal texts of different ids may lie in different shards.  Very long texts are one record, whose slot weighs as much.  Other columns are
left out, whatever their names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path

N_SLOTS = 4096
OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """Slot-to-shard placement; each edit has the next version and says which slots it moved."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]
    moved: tuple[int, ...] = field(default=())

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, s, x) for s, x in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the table of maps."""
        self.frame(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, the latest unless one is named."""
    maps = spark.read.parquet(path)
    version = version if version is not None else maps.agg(F.max("version")).first()[0]
    rows = sorted((r.virtual_slot, r.shard) for r in maps.where(F.col("version") == version).collect())
    return SlotMap(version, max(x for _, x in rows) + 1, tuple(x for _, x in rows))


def place(weights: list[int], n_shards: int) -> SlotMap:
    """Version 1: the heaviest slot goes to the lightest shard; ties by number."""
    loads = [(0, k) for k in range(n_shards)]
    shard_of = [0] * len(weights)
    for slot in sorted(range(len(weights)), key=lambda s: (-weights[s], s)):
        load, k = loads[0]
        shard_of[slot] = k
        heapq.heapreplace(loads, (load + weights[slot], k))
    return SlotMap(1, n_shards, tuple(shard_of))


def rebalance(old: SlotMap, weights: list[int], n_shards: int | None = None) -> SlotMap:
    """The next version: slots leave shards over the mean, lightest that fits first, for the lightest shard; few move."""
    n = n_shards or old.n_shards
    shard_of, loads = list(old.shard_of), [0] * n
    held: dict[int, list[int]] = {k: [] for k in range(n)}
    loose = []
    for s, k in enumerate(shard_of):
        if k < n:
            loads[k] += weights[s]
            held[k].append(s)
        else:
            loose.append(s)
    mean, moved = sum(weights) / n, []
    for s in sorted(loose, key=lambda s: (-weights[s], s)):
        k = min(range(n), key=lambda k: (loads[k], k))
        shard_of[s], loads[k] = k, loads[k] + weights[s]
        moved.append(s)
    for k in sorted(range(n), key=lambda k: (-loads[k], k)):
        for s in sorted(held[k], key=lambda s: (-weights[s], s)):
            to = min(range(n), key=lambda j: (loads[j], j))
            if loads[k] > mean and loads[to] + weights[s] < loads[k] and loads[k] - weights[s] >= mean * 0.98:
                shard_of[s], loads[k], loads[to] = to, loads[k] - weights[s], loads[to] + weights[s]
                moved.append(s)
    return replace(old, version=old.version + 1, n_shards=n, shard_of=tuple(shard_of), moved=tuple(sorted(moved)))


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """``key``, ``size``, ``text_crc32`` and ``virtual_slot`` of each record; the text goes no further than this scan."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    return docs.select(
        F.col(id_col).alias("key"),
        (F.octet_length(text).cast("bigint") + OVERHEAD).alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), crc, F.octet_length(text), F.lit("slot")), F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )


def slot_weights(slotted: DataFrame, n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot."""
    size, rows = [0] * n_slots, [0] * n_slots
    for r in slotted.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect():
        size[r.virtual_slot], rows[r.virtual_slot] = r["size"], r["rows"]
    return size, rows


def assign(slotted: DataFrame, slot_map: SlotMap, rows: list[int]) -> DataFrame:
    """``shard`` and ``slot``, the place in the shard from 0 without gaps.

    Places are counted within a virtual slot, in parallel for all slots; a slot begins where the slots before it in its shard end.
    """
    at, begins = [0] * slot_map.n_shards, []
    for s, k in enumerate(slot_map.shard_of):
        begins.append((s, k, at[k]))
        at[k] += rows[s]
    placed = slotted.sparkSession.createDataFrame(begins, "virtual_slot int, shard int, begins bigint")
    within = Window.partitionBy("virtual_slot").orderBy("key", "text_crc32", "size")
    return (
        slotted.withColumn("place", F.row_number().over(within))
        .join(F.broadcast(placed), "virtual_slot")  # n_slots rows
        .withColumn("slot", F.col("begins") + F.col("place") - 1)
        .drop("begins", "place")
    )


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Documents on shards of near-equal bytes (law ``bytes``), by the latest version of the map that is stored in the shared folder."""
    slotted = with_slots(docs)
    size, rows = slot_weights(slotted.select("virtual_slot", "size"))
    path = shared_path(docs.sparkSession, "slot-map")
    first = place(size, n_shards)
    first.save(docs.sparkSession, path)
    rebalance(first, size).save(docs.sparkSession, path)
    slot_map = load_map(docs.sparkSession, path)
    return assign(slotted, slot_map, rows).select(
        F.col("key").cast("bigint").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(slot_map.version).alias("map_version"),
    )
