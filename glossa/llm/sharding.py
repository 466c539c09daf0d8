"""Sharding by fixed virtual slots and a versioned slot-to-shard map, in DataFrame operations only.

Records are hashed into a fixed number of slots. A map gives each slot its
shard; its versions are rows of one table. Adding a shard edits the map: the
new shard takes an even number of slots from every other one and nothing else
moves. With law ``key`` the map follows from the numbers of slots and shards
alone, so doc_id and shard count decide a record's shard. ``rebalance`` is the
edit that follows the bytes of the slots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.llm.store import NO_ID

SLOTS = 4096
OVERHEAD = 16


def grow(owners: Sequence[int]) -> list[int]:
    """The map with one more shard, which takes slots from those that own most until it has its even part."""
    new = max(owners, default=-1) + 1
    owners = list(owners)
    held: dict[int, list[int]] = {}
    for slot, shard in enumerate(owners):
        held.setdefault(shard, []).append(slot)
    for _ in range(len(owners) // (new + 1)):
        giver = max(held, key=lambda s: (len(held[s]), -s))
        owners[held[giver].pop()] = new
    return owners


def even_map(n_shards: int, n_slots: int = SLOTS) -> list[int]:
    owners = [0] * n_slots
    for _ in range(n_shards - 1):
        owners = grow(owners)
    return owners


def rebalance(owners: Sequence[int], slot_bytes: Sequence[int], slack: float = 0.05) -> list[int]:
    """The map with slots moved from the heaviest shard to the lightest, while that narrows the gap and it is above ``slack``."""
    owners = list(owners)
    load = {s: 0 for s in owners}
    for slot, shard in enumerate(owners):
        load[shard] += slot_bytes[slot]
    mean = sum(load.values()) / max(1, len(load))
    while True:
        heavy, light = max(load, key=lambda s: (load[s], s)), min(load, key=lambda s: (load[s], s))
        gap = load[heavy] - load[light]
        if load[heavy] <= mean * (1 + slack):
            return owners
        movable = [(slot_bytes[i], i) for i, s in enumerate(owners) if s == heavy and 0 < slot_bytes[i] < gap]
        if not movable:
            return owners
        b, slot = min(movable, key=lambda x: (abs(gap / 2 - x[0]), x[1]))
        owners[slot] = light
        load[heavy] -= b
        load[light] += b


def map_table(spark: SparkSession, versions: Sequence[Sequence[int]]) -> DataFrame:
    """(version, slot, shard); versions count from 1. Its size is fixed: slots times versions."""
    tables = [
        spark.range(len(owners)).select(F.lit(v).alias("version"), F.col("id").cast("int").alias("vslot"), F.element_at(F.split(F.lit(",".join(map(str, owners))), ","), F.col("id").cast("int") + 1).cast("int").alias("shard"))
        for v, owners in enumerate(versions, 1)
    ]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def slot_of(n_slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))), F.lit(n_slots)).cast("int")


def record_size() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(OVERHEAD)


def slot_bytes(docs: DataFrame, n_slots: int = SLOTS) -> list[int]:
    """The bytes of each virtual slot; one row per slot comes to the driver."""
    sums = docs.groupBy(slot_of(n_slots).alias("vslot")).agg(F.sum(record_size()).alias("n"))
    out = [0] * n_slots
    for r in sums.collect():
        out[r.vslot] = r.n
    return out


def assign(docs: DataFrame, slot_map: DataFrame, n_slots: int = SLOTS, size: Column | None = None, tie: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``docs`` with vslot, shard and slot (place within its shard, from 0), and the map's newest version with rows and bytes of each slot.

    Rows of a shard stand in order of virtual slot, then doc_id, then text
    hash. Places come from counts per virtual slot, so that no task holds a
    shard. Null text: size 16. Null doc_id: hashed as one value. Rows that
    share a doc_id share a shard. Empty table: no rows. Columns of ``docs``
    named vslot, shard, slot, slot_at, slot_start or record_size give way.
    ``size`` and ``tie`` stand for a record's bytes and text hash where ``docs``
    has no text.
    """
    d = docs.drop("vslot", "shard", "slot", "slot_at", "slot_start", "record_size").withColumns({"vslot": slot_of(n_slots), "record_size": record_size() if size is None else size})
    newest = slot_map.where(F.col("version") == slot_map.agg(F.max("version")).first()[0]).drop("version")
    weighed = newest.join(d.groupBy("vslot").agg(F.count("*").alias("n_rows"), F.sum("record_size").alias("n_bytes")), "vslot", "left").na.fill(0, ["n_rows", "n_bytes"])
    along = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = weighed.withColumn("slot_start", F.coalesce(F.sum("n_rows").over(along), F.lit(0)))
    here = Window.partitionBy("vslot").orderBy("doc_id", F.xxhash64("text") if tie is None else tie)
    out = d.withColumn("slot_at", F.row_number().over(here)).join(F.broadcast(starts.select("vslot", "shard", "slot_start")), "vslot")  # a row per virtual slot
    out = out.withColumn("slot", (F.col("slot_start") + F.col("slot_at") - 1).cast("long")).drop("slot_start", "slot_at", "record_size")
    return out, weighed
