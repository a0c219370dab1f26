"""Sharding over fixed virtual slots, in DataFrame functions only.

Every record hashes into one of a few thousand virtual slots that never change.
What changes is the slot-to-shard map: a small versioned table, edited when the
bytes per slot ask for it. Records never move between slots, so a rebalance
rewrites only the slots whose entry changed.

Defined results
* law `bytes`: slots hash (id, text), so equal texts are not kept together and a
  group of copies spreads over the shards;
* null text: size 1 (no bytes plus one), CRC of the empty string;
* null id: hashes like any other value;
* repeated rows: the same slot, next to each other;
* empty table: an empty result, and a map with every slot assigned;
* extra columns are ignored; columns named like the working ones do not clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cropframe.llm.common import lookup
from cropframe.session import scratch_path

SLOTS = 4096


def virtual_slot(cols: Sequence[str | Column], slots: int = SLOTS) -> Column:
    """The record's fixed slot."""
    return F.pmod(F.xxhash64(*cols), F.lit(slots)).cast("int")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot: all that sharding needs, without the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        virtual_slot([F.col(id_col), text], slots).alias("vslot"))


def slot_totals(recs: DataFrame) -> DataFrame:
    """Bytes and rows per slot: at most one row per slot, however many records."""
    return recs.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def balanced_map(weights: Sequence[int], shards: int) -> list[int]:
    """slot -> shard: the heaviest slot first, each to the lightest shard so far."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(weights)
    for slot in sorted(range(len(weights)), key=lambda k: (-weights[k], k)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + weights[slot], shard))
    return out


def rebalance(current: Sequence[int], weights: Sequence[int], shards: int,
              tolerance: float = 0.02) -> list[int]:
    """Edit a map for new weights or more shards, moving few slots.

    Slots leave only shards above the mean, the largest that still fits first,
    into the lightest shard, until every shard is within ``tolerance`` of the
    mean or no move helps. Untouched slots keep their shard.
    """
    out = list(current)
    load = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(out):
        load[shard] += weights[slot]
        held[shard].append(slot)
    goal = sum(weights) / shards
    for h in held:
        h.sort(key=lambda k: (weights[k], k))
    while True:
        low = min(range(shards), key=lambda s: (load[s], s))
        high = max(range(shards), key=lambda s: (load[s], -s))
        if load[high] <= goal * (1 + tolerance) and load[low] >= goal * (1 - tolerance):
            return out
        gap = load[high] - load[low]
        fits = [k for k in held[high] if 0 < weights[k] < gap]
        if not fits:
            return out
        room = goal - load[low]
        slot = max((k for k in fits if weights[k] <= room), key=lambda k: weights[k], default=fits[0])
        held[high].remove(slot)
        held[low].append(slot)
        held[low].sort(key=lambda k: (weights[k], k))
        load[high] -= weights[slot]
        load[low] += weights[slot]
        out[slot] = low


def weights_of(recs: DataFrame, slots: int = SLOTS, by: str = "bytes") -> list[int]:
    """Bytes (or rows) of each slot as a list: ``slots`` numbers at any input size."""
    got = {r["vslot"]: r[by] for r in slot_totals(recs).collect()}
    return [int(got.get(k, 0)) for k in range(slots)]


def map_frame(spark: SparkSession, mapping: Sequence[int], version: int) -> DataFrame:
    """The map as a table: version, vslot, shard."""
    return spark.range(len(mapping)).select(
        F.lit(version).alias("version"), F.col("id").cast("int").alias("vslot"),
        lookup(mapping, F.col("id")).cast("int").alias("shard"))


def store_map(spark: SparkSession, mapping: Sequence[int], version: int, path: str | None = None) -> str:
    """Add one version of the map under ``path`` (a folder per version; none is overwritten)."""
    path = path or scratch_path(spark, "slot-map")
    map_frame(spark, mapping, version).drop("version").write.parquet(f"{path}/version={version}")
    return path


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    """A stored version of the map, the latest if none is named."""
    m = spark.read.parquet(path)
    if version is None:
        version = m.agg(F.max("version")).first()[0]
    rows = m.where(F.col("version") == version).select("vslot", "shard").collect()
    return [r["shard"] for r in sorted(rows, key=lambda r: r["vslot"])]


def stored_version(spark: SparkSession, path: str | None) -> int:
    """The latest version of the map under ``path``, 0 if there is none."""
    if not path:
        return 0
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return 0
    return spark.read.parquet(path).agg(F.max("version")).first()[0] or 0


def assign(recs: DataFrame, mapping: Sequence[int]) -> DataFrame:
    """Records with their shard and their place ``slot`` in it, gapless from 0.

    Places are counted per virtual slot (thousands of small sorted groups) and
    shifted by the rows of the slots before it in the shard, so no task ever
    holds a whole shard.
    """
    rows = weights_of(recs, len(mapping), "rows")
    filled: dict[int, int] = {}
    before = []
    for slot, shard in enumerate(mapping):
        before.append(filled.get(shard, 0))
        filled[shard] = before[-1] + rows[slot]
    w = "row_number() over (partition by vslot order by doc_id, text_crc32, size) - 1"
    return recs.select(
        "doc_id", "size", "text_crc32", "vslot",
        lookup(mapping, F.col("vslot")).cast("int").alias("shard"),
        (F.expr(w) + lookup(before, F.col("vslot"))).cast("long").alias("slot"))


def shard_by_bytes(docs: DataFrame, shards: int = 16, slots: int = SLOTS, id_col: str = "doc_id",
                   text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """Records in ``shards`` shards of near equal bytes.

    Where ``map_path`` holds a map, its latest version is edited for the bytes
    that the slots have now (``rebalance``) and stored as the next version, so
    only the records of the moved slots change their shard; else a fresh map is
    stored as version 1. A map with another number of slots is an error.
    """
    from cropframe.llm.common import staged

    spark = docs.sparkSession
    recs = staged(records(docs, id_col, text_col, slots), "shard-records")
    weights, version = weights_of(recs, slots), stored_version(spark, map_path)
    if version:
        old = load_map(spark, map_path, version)
        if len(old) != slots:
            raise ValueError(f"the stored map has {len(old)} slots, not {slots}")
        mapping = rebalance(old, weights, shards)
    else:
        mapping = balanced_map(weights, shards)
    path = store_map(spark, mapping, version + 1, map_path)
    return assign(recs, load_map(spark, path, version + 1))
