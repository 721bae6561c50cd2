"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's slot is the leading 32 bits of md5(doc_id) modulo SLOTS, whatever the number of shards.  One aggregation with
map-side sums gives bytes and records of each slot (SLOTS rows); the map from slots to shards is edited on the driver from these rows
alone.  Rebalancing moves slots, not records: from the fullest shard to the emptiest, until the fullest is within the
tolerance or no move helps; all other slots stay where they were, and the edited map is stored as the next version beside
the earlier ones, in a folder that all executors share; the next run reads the latest and edits that.  Records reach their shards by a broadcast join with the map's fixed number of rows, so texts
aren't shuffled.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, small, table

SLOTS, SHARDS, TOLERANCE = 4096, 16, 0.02
MAP = "version int, slot int, shard int, bytes long, records long"


def slot(id_col: Column, slots: int = SLOTS) -> Column:
    """A null id has the slot of the empty string."""
    return (F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % slots).cast("int")


def slot_bytes(docs: DataFrame, slots: int = SLOTS) -> list[tuple[int, int]]:
    """(bytes, records) of each slot; a null text has no bytes."""
    out = [(0, 0)] * slots
    for s, b, n in docs.select(slot(docs["doc_id"], slots).alias("__s"), F.coalesce(F.octet_length(docs["text"]), F.lit(0)).cast("long").alias("__b")).groupBy("__s").agg(F.sum("__b"), F.count("*")).collect():
        out[s] = (b, n)
    return out


def rebalance(shard_of: list[int], size: list[int], shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """The edited map.  From the fullest shard the largest slot that brings the pair of fullest and emptiest closer goes to the
    emptiest (ties: the least slot number), until the fullest has at most (1 + tolerance) times the mean or nothing moves.
    Slots of shards that are no more (shard >= shards) are placed first, largest first, on the emptiest shard."""
    now = list(shard_of)
    load, own = [0] * shards, defaultdict(list)
    for s, k in enumerate(now):
        if k < shards:
            load[k] += size[s]
            own[k].append((size[s], -s))
    for s in sorted((s for s, k in enumerate(now) if k >= shards), key=lambda s: (-size[s], s)):
        k = min(range(shards), key=lambda k: (load[k], k))
        now[s] = k
        load[k] += size[s]
        own[k].append((size[s], -s))
    for k in own:
        own[k].sort()
    mean = sum(load) / shards
    while True:
        top, low = max(range(shards), key=lambda k: (load[k], -k)), min(range(shards), key=lambda k: (load[k], k))
        gap = load[top] - load[low]
        if load[top] <= (1 + tolerance) * mean or gap <= 0:
            return now
        fit = [x for x in own[top] if 0 < x[0] < gap]
        if not fit:
            return now
        best = max(fit, key=lambda x: (min(x[0], gap - x[0]), x[1]))
        own[top].remove(best)
        own[low].append(best)
        own[low].sort()
        load[top] -= best[0]
        load[low] += best[0]
        now[-best[1]] = low


def slot_map(docs: DataFrame, previous: DataFrame | None = None, shards: int = SHARDS, slots: int = SLOTS, tolerance: float = TOLERANCE) -> DataFrame:
    """The versions so far and the next one: (version, slot, shard, bytes, records).  Without earlier versions, version 0 deals the
    slots out in turn and version 1 is rebalanced.  Empty tables keep the map as it is dealt."""
    size = slot_bytes(docs, slots)
    rows = [tuple(r) for r in previous.select("version", "slot", "shard", "bytes", "records").collect()] if previous is not None else []
    return small(docs.sparkSession, rows + _edited(rows, size, shards, tolerance), MAP)


def _edited(rows: list[tuple], size: list[tuple[int, int]], shards: int, tolerance: float) -> list[tuple]:
    """The rows that follow those of the earlier versions."""
    out = []
    if not rows:
        out = rows = [(0, s, s % shards, *x) for s, x in enumerate(size)]
    last = max(r[0] for r in rows)
    now = {s: k for v, s, k, _, _ in rows if v == last}
    if sorted(now) != list(range(len(size))):
        raise ValueError(f"the stored map has {len(now)} slots, not {len(size)}: their number is fixed")
    edited = rebalance([now[s] for s in range(len(size))], [b for b, _ in size], shards, tolerance)
    return out + [(last + 1, s, edited[s], *size[s]) for s in range(len(size))]


def stored_versions(spark: SparkSession, folder: str) -> DataFrame | None:
    """All complete versions in the folder (version, slot, shard, bytes, records); None where there are none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [f"{folder}/{x.getPath().getName()}" for x in (fs.listStatus(at) if fs.exists(at) else []) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    return spark.read.schema(MAP).parquet(*done) if done else None


def store_map(docs: DataFrame, folder: str, shards: int = SHARDS, slots: int = SLOTS, tolerance: float = TOLERANCE) -> DataFrame:
    """Edits the latest map in the folder for docs and returns all versions, read from it.

    Each version is a table of its own below the folder and is never changed.  Where there is none yet, versions 0 (dealt in turn) and 1 are
    written; where the latest needs no move, nothing is written and it stays the latest.  A version that a lost driver left
    half written isn't read and is written again.
    """
    spark = docs.sparkSession
    before = stored_versions(spark, folder)
    rows = [tuple(r) for r in before.collect()] if before is not None else []
    new = _edited(rows, slot_bytes(docs, slots), shards, tolerance)
    last = max((r[0] for r in rows), default=-1)
    if rows and {(s, k) for v, s, k, *_ in rows if v == last} == {(s, k) for _, s, k, *_ in new}:
        return before
    for v in sorted({r[0] for r in new}):
        small(spark, [r for r in new if r[0] == v], MAP).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{v:08d}")
    return stored_versions(spark, folder)


def map_folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Where the map of a folder's table is kept, in the shared checkpoint folder."""
    return shared_folder(spark, f"slot-map-{name}-{hashlib.md5(sf_dir.encode()).hexdigest()}")


def sharded(docs: DataFrame, versions: DataFrame, slots: int = SLOTS, version: int | None = None) -> DataFrame:
    """All rows and columns of docs with slot, shard and map_version (which replace columns of these names) by a version of the map, the
    latest by default.

    A null id has the slot of the empty string, a null text no bytes, a very long text all of its bytes in one slot; rows that repeat an id
    share its slot; ids of any type are hashed as strings.  Ties between slots or shards go to the least number.  An empty table gives an
    empty one.
    """
    last = versions.agg(F.max("version")).first()[0] if version is None else version
    at = versions.where(F.col("version") == last).select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    keep = [c for c in docs.columns if c not in ("slot", "shard", "map_version")]
    own = docs.select(*keep).withColumn("slot", slot(docs["doc_id"], slots))
    joined = own.join(F.broadcast(at), own["slot"] == at["__slot"])
    return joined.select(*[own[c] for c in keep], own["slot"], at["__shard"].alias("shard"), F.lit(last).cast("int").alias("map_version"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    return sharded(got, store_map(docs, map_folder(spark, sf_dir, "documents")))


QUERIES = {"op7_sharding": op7_sharding}
