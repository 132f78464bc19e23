"""Sharding through fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into ``SLOTS`` virtual slots; bytes and rows are summed per slot; a map from slot
to shard is packed by bytes (largest slot first into the lightest shard) and
stored as a numbered version.  Rebalancing edits a copy of the map: it moves as few
slots as it takes and stores the next version; records never change their slot.

Equal texts share a slot, so copies stay together, unless they hold more than a ``1 / PIECES`` of a shard by
bytes or rows; such a text is spread over several slots row by row, also where its rows have one doc_id.  There are at most
2 * PIECES * shards of them, which bounds the broadcast.  The map has SLOTS rows, whatever the data.

A row's ``slot`` is its place in its shard, gapless from 0: the rows of the
shard's earlier virtual slots (from the map) plus its place in its own, so no shard is ever sorted in one task.

Defined cases: null text has size 8 and CRC 0; repeated rows each get a place of their own; rows are placed by
(doc_id, size, CRC); null doc_ids are hashed like any other value; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shotlane.llm.common import two_hashes, whole_text
from shotlane.session import cut, scratch_path

SLOTS, PIECES = 8192, 16


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the text's hash and a number of every row, written once."""
    h1, h2 = two_hashes(whole_text())
    size = F.octet_length(whole_text()).cast("long") + 8
    return cut(docs.select("doc_id", size.alias("size"), F.crc32(F.encode(whole_text(), "UTF-8")).alias("text_crc32"), h1.alias("h1"), h2.alias("h2"), F.monotonically_increasing_id().alias("row_no")), "digests")


def slotted(rows: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """``rows`` (of ``digests``) plus vslot."""
    total = rows.agg(F.sum("size"), F.count("*")).first()
    share = lambda whole: max(1, (whole or 0) // (shards * PIECES))
    copies = rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    parts = F.greatest(F.ceil(F.col("bytes") / share(total[0])), F.ceil(F.col("n") / share(total[1]))).cast("int")
    wide = F.broadcast(copies.filter((F.col("n") > 1) & ((F.col("bytes") > share(total[0])) | (F.col("n") > share(total[1])))).select("h1", "h2", parts.alias("parts")))
    salt = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "row_no"), F.col("parts")).cast("int"))
    return rows.join(wide, ["h1", "h2"], "left").withColumn("vslot", F.pmod(F.xxhash64("h1", "h2", salt), F.lit(slots)).cast("int")).drop("parts")


def weigh(rows: DataFrame) -> DataFrame:
    """Bytes and rows per virtual slot."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def packed(weights: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """(slot, bytes) -> shard: the heaviest slot first, each into the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot, size in sorted(weights, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def rebalanced(old: dict[int, int], weights: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """``old`` edited for ``shards`` shards: slots of shards that are gone, and slots of shards above the mean, move to the lightest."""
    size = dict(weights)
    new = dict(old)
    load = {s: 0 for s in range(shards)}
    by = {s: [] for s in range(shards)}
    loose = []
    for slot, shard in old.items():
        if shard < shards:
            load[shard] += size.get(slot, 0)
            by[shard].append(slot)
        else:
            loose.append(slot)
    mean = sum(size.values()) / max(1, shards)
    for shard, mine in by.items():
        for slot in sorted(mine, key=lambda x: (size.get(x, 0), x)):  # small slots fill exactly
            if load[shard] - size.get(slot, 0) < mean:
                break
            load[shard] -= size.get(slot, 0)
            loose.append(slot)
    heap = [(v, s) for s, v in load.items()]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda x: (-size.get(x, 0), x)):
        v, shard = heapq.heappop(heap)
        new[slot] = shard
        heapq.heappush(heap, (v + size.get(slot, 0), shard))
    return new


def store_map(spark: SparkSession, base: str, version: int, weights: DataFrame, shard_of: dict[int, int], slots: int = SLOTS) -> DataFrame:
    """Write version ``version`` of the map under ``base`` (it must be new) and return it: version, vslot, shard, bytes, n, before.

    ``before`` counts the rows of the shard's earlier slots.
    """
    flat = json.dumps([shard_of.get(i, i % max(1, max(shard_of.values(), default=0) + 1)) for i in range(slots)])
    every = spark.range(slots).select(F.col("id").cast("int").alias("vslot"), F.element_at(F.from_json(F.lit(flat), "array<int>"), (F.col("id") + 1).cast("int")).alias("shard"))
    full = every.join(weights, "vslot", "left").select(F.lit(version).alias("version"), "vslot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n", F.lit(0)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1))
    path = f"{base}/version={version}"
    full.withColumn("before", F.coalesce(before, F.lit(0))).drop("version").coalesce(1).write.parquet(path)
    return load_map(spark, base, version)


def load_map(spark: SparkSession, base: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{base}/version={version}").withColumn("version", F.lit(version))


def newest_version(spark: SparkSession, base: str) -> int:
    return spark.read.parquet(base).agg(F.max("version")).first()[0]


def rebalance(docs: DataFrame, shards: int, base: str, slots: int = SLOTS) -> DataFrame:
    """Rows placed by the newest map under ``base`` edited for ``shards`` shards and today's bytes; the edit is stored as the next version.

    Columns as of ``shard``.
    """
    spark = docs.sparkSession
    version = newest_version(spark, base)
    rows = slotted(digests(docs), shards, slots)
    weights = cut(weigh(rows), "slot-weights")
    old = {r["vslot"]: r["shard"] for r in load_map(spark, base, version).select("vslot", "shard").collect()}  # ``slots`` rows
    pairs = [(r["vslot"], r["bytes"]) for r in weights.select("vslot", "bytes").collect()]
    slot_map = store_map(spark, base, version + 1, weights, rebalanced(old, pairs, shards), slots)
    return place(rows, slot_map).select("doc_id", "size", "text_crc32", "vslot", "shard", "slot", F.lit(version + 1).alias("map_version"))


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` (of ``slotted``) plus shard and slot, the place in the shard."""
    at = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32"))
    joined = rows.withColumn("__at", at).join(F.broadcast(slot_map.select("vslot", "shard", "before")), "vslot")  # one row per virtual slot
    return joined.withColumn("slot", F.col("before") + F.col("__at") - 1).drop("before", "__at")


def shard(docs: DataFrame, shards: int, base: str | None = None, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, slot, map_version of every row; version 1 of the map is stored under ``base``."""
    spark = docs.sparkSession
    rows = slotted(digests(docs), shards, slots)
    weights = cut(weigh(rows), "slot-weights")
    pairs = [(r["vslot"], r["bytes"]) for r in weights.select("vslot", "bytes").collect()]  # at most ``slots`` rows
    slot_map = store_map(spark, base or scratch_path(spark, "slot-map"), 1, weights, packed(pairs, shards), slots)
    return place(rows, slot_map).select("doc_id", "size", "text_crc32", "vslot", "shard", "slot", F.lit(1).alias("map_version"))
