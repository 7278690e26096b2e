"""Sharding by fixed virtual slots and a versioned slot-to-shard map that is edited, never rebuilt."""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.base import cut, documents, load, shared_dir

SLOTS = 8192


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each virtual slot; every edit gives a map of the next version."""

    version: int
    shards: int
    owner: tuple[int, ...]

    @staticmethod
    def first(shards: int, slots: int = SLOTS) -> SlotMap:
        return SlotMap(1, shards, tuple(s * shards // slots for s in range(slots)))

    def loads(self, weights: list[int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.owner):
            out[shard] += weights[slot]
        return out

    def rebalanced(self, weights: list[int]) -> SlotMap:
        """Move slots from the heaviest to the lightest shard as long as that brings the two nearer; the largest slot of at most half the gap goes, else the smallest that still helps."""
        owner, load = list(self.owner), self.loads(weights)
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(owner):
            if weights[slot]:
                held[shard].append((weights[slot], slot))
        for h in held:
            h.sort()
        while True:
            top, low = max(range(self.shards), key=load.__getitem__), min(range(self.shards), key=load.__getitem__)
            gap = load[top] - load[low]
            at = _last_at_most(held[top], gap // 2)
            at = at if at >= 0 else 0
            if not held[top] or held[top][at][0] >= gap:
                break
            weight, slot = held[top].pop(at)
            held[low].insert(_last_at_most(held[low], weight) + 1, (weight, slot))
            owner[slot] = low
            load[top] -= weight
            load[low] += weight
        return SlotMap(self.version + 1, self.shards, tuple(owner))

    def grown(self, weights: list[int]) -> SlotMap:
        """One more shard, which takes slots from the heaviest ones until it has its share; no slot moves between old shards."""
        owner, new, load = list(self.owner), self.shards, self.loads(weights)
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(owner):
            held[shard].append((weights[slot], slot))
        for h in held:
            h.sort()
        order = [(-w, s) for s, w in enumerate(load)]
        heapq.heapify(order)
        share, got = sum(load) // (self.shards + 1), 0
        while got < share and order:
            w, shard = heapq.heappop(order)
            at = _last_at_most(held[shard], share - got)
            if at < 0 or not held[shard][at][0]:
                continue
            weight, slot = held[shard].pop(at)
            owner[slot], got = new, got + weight
            heapq.heappush(order, (w + weight, shard))
        return SlotMap(self.version + 1, self.shards + 1, tuple(owner))

    def store(self, spark: SparkSession, folder: str) -> SlotMap:
        """Write the map as one version below folder (one row for each slot); a version that is there already stays."""
        rows = spark.createDataFrame([(self.shards, s, o) for s, o in enumerate(self.owner)], "shards int, virtual_slot int, shard int")
        rows.coalesce(1).write.mode("ignore").parquet(f"{folder}/version={self.version}")
        return self

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
        """A stored version, the last one by default."""
        rows = spark.read.parquet(folder)
        if version is None:
            version = rows.agg(F.max("version")).first()[0]
        held = sorted((r["virtual_slot"], r["shard"], r["shards"]) for r in rows.where(F.col("version") == version).collect())
        return SlotMap(int(version), held[0][2], tuple(o for _, o, _ in held))


def _last_at_most(sorted_pairs: list[tuple[int, int]], weight: int) -> int:
    low, high = 0, len(sorted_pairs)
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if sorted_pairs[mid][0] <= weight else (low, mid)
    return low - 1


def weighed(rows: DataFrame, slot: Column, slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot: at most ``slots`` numbers reach the driver."""
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy(slot.alias("slot")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect():
        size[r["slot"]], count[r["slot"]] = r["size"], r["n"]
    return size, count


def assign(rows: DataFrame, shards: int, folder: str, slots: int = SLOTS, crowd: int = 16) -> tuple[DataFrame, SlotMap]:
    """rows(size, group, spread, ...) -> the rows with virtual_slot, and the map after balancing its bytes.

    The map is kept in folder: the last version there (a first one where there is none)
    is loaded, edited by the moves that balance the bytes, and stored as the next.

    A record goes to the slot of its group's hash, so that equal texts share a shard.
    Slots that this fills with more than 1/``crowd`` of a shard, in bytes or rows, are
    spread by the hash of the record itself; there can be at most 2 * crowd * shards of them.
    """
    by_group = F.pmod(F.xxhash64("group"), F.lit(slots)).cast("int")
    size, count = weighed(rows, by_group, slots)
    crowded = [s for s in range(slots) if size[s] * shards * crowd > sum(size) or count[s] * shards * crowd > sum(count)]
    crowded = [s for s in crowded if count[s] > 1]
    by_record = F.pmod(F.xxhash64("spread"), F.lit(slots)).cast("int")
    slot = F.when(by_group.isin(crowded), by_record).otherwise(by_group) if crowded else by_group
    size, _ = weighed(rows, slot, slots)
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        SlotMap.first(shards, slots).store(spark, folder)
    edited = SlotMap.load(spark, folder).rebalanced(size).store(spark, folder)
    return rows.withColumn("virtual_slot", slot), SlotMap.load(spark, folder, edited.version)


def op6_sharding(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    """Shard and place of every document, with shard sizes near equal (law ``bytes``).

    slot is the row's place in its shard: rows of earlier virtual slots of the shard,
    then the rank inside its own. Null texts count as empty (8 bytes) and are one
    group; repeated rows each get a place; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = documents(load(spark, sf_dir, "documents"))
    rows = cut(docs.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group"), F.xxhash64("doc_id", text).alias("spread")), "sizes")
    placed, slot_map = assign(rows, shards, f"{shared_dir(spark)}/quillstone-slot-map-{uuid.uuid4().hex}")
    _, count = weighed(placed, F.col("virtual_slot"), SLOTS)
    before, first = [0] * shards, []
    for s, shard in enumerate(slot_map.owner):
        first.append((s, shard, before[shard]))
        before[shard] += count[s]
    stored = spark.createDataFrame(first, "virtual_slot int, shard int, first bigint")
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "spread", "size"))
    return placed.withColumn("rank", rank).join(F.broadcast(stored), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version")
    )
