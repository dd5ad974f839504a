"""Sharding by fixed virtual slots.

Every record is hashed into one of a few thousand slots.  Bytes are summed per slot, and a
versioned slot-to-shard map, small by construction, says where a slot lives.  Rebalancing
edits the map: whole slots move, records are never rehashed.

Rows with a null text count as empty (one byte).  Null ids are hashed like any other value.  Rows equal in id and text are told
apart by a number: in ``shard_numbers`` always, in ``shard_documents`` where they hold more bytes than the average slot (so there
are fewer such groups than slots); else they share a slot.  So no slot grows with a group of repeated rows.  Rows of a slot that tie
in id, size and checksum are interchangeable.  Whole texts count, however long; one text is never split over slots.  An
empty table gives no rows.  Columns of the input that are called like an output column are replaced; others stay.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import unused
from factloom.plans.scratch import materialise

SLOTS, SHARDS = 4096, 16
#: Equal records that one row writes out.
PART = 1000


@dataclass(frozen=True)
class SlotMap:
    """Slot i lives in shards[i].  ``version`` goes up by one with each edit."""

    shards: tuple[int, ...]
    n_shards: int
    version: int = 1
    moved: tuple[int, ...] = field(default=())

    def frame(self, spark: SparkSession) -> DataFrame:
        """At most as many rows as there are slots, so it can be broadcast at any corpus size."""
        return spark.createDataFrame(list(enumerate(self.shards)), "virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version below ``path``; earlier versions stay."""
        rows = [(self.version, self.n_shards, s, x) for s, x in enumerate(self.shards)]
        spark.createDataFrame(rows, "version int, n_shards int, virtual_slot int, shard int").coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """The given version, or else the latest."""
    rows = spark.read.parquet(path)
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    found = rows.filter(F.col("version") == version).orderBy("virtual_slot").collect()
    if not found:
        raise ValueError(f"no slot map of version {version} at {path}")
    return SlotMap(tuple(r["shard"] for r in found), found[0]["n_shards"], version)


def latest(spark: SparkSession, path: str) -> SlotMap | None:
    """None if there is no map at ``path``."""
    try:
        return load_map(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def balanced_map(slot_bytes: list[int], n_shards: int) -> SlotMap:
    """Largest slot first, each to the lightest shard."""
    heap = [(0, s) for s in range(n_shards)]
    shards = [0] * len(slot_bytes)
    for slot in sorted(range(len(slot_bytes)), key=lambda i: (-slot_bytes[i], i)):
        load, shard = heap[0]
        shards[slot] = shard
        heapq.heapreplace(heap, (load + slot_bytes[slot], shard))
    return SlotMap(tuple(shards), n_shards)


def rebalanced_map(old: SlotMap, slot_bytes: list[int], n_shards: int, tolerance: float = 0.02) -> SlotMap:
    """The next version: as few slots as needed move from heavy shards to light ones.

    Slots of shards that no longer exist move first; then, while a shard is more than ``tolerance``
    away from the mean, the heaviest gives the lightest the slot that best evens them out.
    """
    shards, loads, held = list(old.shards), [0] * n_shards, [[] for _ in range(n_shards)]
    homeless = []
    for slot, shard in enumerate(shards):
        if shard < n_shards:
            loads[shard] += slot_bytes[slot]
            held[shard].append(slot)
        else:
            homeless.append(slot)

    def put(slot: int, shard: int) -> None:
        shards[slot] = shard
        loads[shard] += slot_bytes[slot]
        held[shard].append(slot)

    for slot in sorted(homeless, key=lambda s: (-slot_bytes[s], s)):
        put(slot, min(range(n_shards), key=lambda s: (loads[s], s)))
    mean = sum(slot_bytes) / n_shards
    while True:
        heavy = max(range(n_shards), key=lambda s: (loads[s], -s))
        light = min(range(n_shards), key=lambda s: (loads[s], s))
        fits = [s for s in held[heavy] if 0 < slot_bytes[s] < loads[heavy] - loads[light]]
        if max(loads[heavy] - mean, mean - loads[light]) <= tolerance * mean or not fits:
            break
        slot = min(fits, key=lambda s: (abs((loads[heavy] - loads[light]) / 2 - slot_bytes[s]), s))
        held[heavy].remove(slot)
        loads[heavy] -= slot_bytes[slot]
        put(slot, light)
    moved = tuple(i for i, (a, b) in enumerate(zip(old.shards, shards, strict=True)) if a != b)
    return SlotMap(tuple(shards), n_shards, old.version + 1, moved)


def size_column() -> Column:
    return (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long")


def crc_column() -> Column:
    return F.crc32(F.coalesce("text", F.lit("")).cast("binary"))


def slot_column(n_slots: int, nth: Column) -> Column:
    """``nth`` (a long) tells rows of equal id and text apart."""
    return F.pmod(F.xxhash64("doc_id", crc_column(), nth), F.lit(n_slots)).cast("int")


def slotted(docs: DataFrame, n_slots: int, name: str) -> DataFrame:
    """``docs`` with a column of slots; rows of (id, text) groups above the average slot's bytes are spread by their place in the input."""
    rows = docs.select(F.col("doc_id").alias("id"), crc_column().alias("crc"), size_column().alias("size"))
    sums = materialise(rows.groupBy("id", "crc").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).filter("n > 1"), "alike")
    total = rows.agg(F.sum("size")).first()[0] or 0
    own, crc, heavy = unused(docs.columns, "id", "crc", "heavy")
    large = sums.filter(F.col("bytes") > total / n_slots).select(F.col("id").alias(own), F.col("crc").alias(crc), F.lit(True).alias(heavy))
    if large.isEmpty():
        return docs.withColumn(name, slot_column(n_slots, F.lit(0).cast("long")))
    out = docs.join(F.broadcast(large), F.col("doc_id").eqNullSafe(F.col(own)) & (crc_column() == F.col(crc)), "left")  # fewer rows than slots
    nth = F.when(F.col(heavy), F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long"))
    return out.withColumn(name, slot_column(n_slots, nth)).drop(own, crc, heavy)


def slot_loads(records: DataFrame, n_slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; the aggregate has n_slots rows at most."""
    sizes, rows = [0] * n_slots, [0] * n_slots
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        sizes[r["virtual_slot"]], rows[r["virtual_slot"]] = r["b"], r["n"]
    return sizes, rows


def stored_map(spark: SparkSession, path: str, slot_bytes: list[int], n_shards: int) -> SlotMap:
    """The latest map at ``path``, edited for these bytes and shards.

    Without a map there, version 1 is made and saved; an edit that moves slots is saved as the next version.
    """
    old = latest(spark, path)
    if old is None:
        old = balanced_map(slot_bytes, n_shards)
        old.save(spark, path)
        return old
    new = rebalanced_map(old, slot_bytes, n_shards)
    if not new.moved and old.n_shards == n_shards:
        return old
    new.save(spark, path)
    return new


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, n_slots: int = SLOTS, slot_map: SlotMap | None = None, map_path: str | None = None) -> DataFrame:
    """``docs`` with virtual_slot, shard and map_version.  Texts aren't shuffled.

    With ``slot_map`` documents go where it says.  With ``map_path`` the map stored there is used, rebalanced and stored again.
    """
    spark, kept = docs.sparkSession, docs.drop("virtual_slot", "shard", "map_version")
    if slot_map is not None:
        n_slots = len(slot_map.shards)
    elif map_path is not None and (known := latest(spark, map_path)):
        n_slots = len(known.shards)
    placed = slotted(kept, n_slots, "virtual_slot")
    if slot_map is None:
        loads = slot_loads(placed.select("virtual_slot", size_column().alias("size")), n_slots)[0]
        slot_map = balanced_map(loads, n_shards) if map_path is None else stored_map(spark, map_path, loads, n_shards)
    out = placed.join(F.broadcast(slot_map.frame(spark)), "virtual_slot")
    return out.select(*(f"`{c}`" for c in kept.columns), "virtual_slot", "shard", F.lit(slot_map.version).alias("map_version"))


def shard_numbers(docs: DataFrame, n_shards: int = SHARDS, n_slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in its shard, gapless from 0), grown_shard, virtual_slot.

    Numbers run through a shard's virtual slots in order, so ranking needs only groups of one slot,
    a few thousandths of the rows each.  Records, not texts, are shuffled.  Equal records are counted and written out again with
    a number each, thousands at a time, so that a large group of them is spread over all slots.
    """
    records = docs.select("doc_id", size_column().alias("size"), crc_column().alias("text_crc32"))
    alike = records.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    alike = alike.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PART))))
    alike = alike.withColumn("nth", F.explode(F.sequence(F.col("part") * PART, F.least("n", F.col("part") * PART + PART) - 1)))
    slot = F.pmod(F.xxhash64("doc_id", "text_crc32", "nth"), F.lit(n_slots)).cast("int")
    records = materialise(alike.select("doc_id", "size", "text_crc32", "nth", slot.alias("virtual_slot")), "records")
    sizes, rows = slot_loads(records, n_slots)
    slot_map = balanced_map(sizes, n_shards)
    first, after = [], [0] * n_shards
    for slot, shard in enumerate(slot_map.shards):
        first.append((slot, shard, after[shard]))
        after[shard] += rows[slot]
    placed = F.broadcast(docs.sparkSession.createDataFrame(first, "virtual_slot int, shard int, before long"))
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32", "nth")
    numbered = records.withColumn("place", F.row_number().over(order).cast("long") - 1).join(placed, "virtual_slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
