"""Mixing sources to target weights by Pfair scheduling.

One slot emits one block of a source.  Source i of weight w_i out of W gets subtasks q = 0, 1, ... with release
time floor(q W / w_i) and deadline ceil((q + 1) W / w_i); in every slot the released subtask with the earliest
deadline goes (ties: by source name).  As the weights add up to W, every subtask meets its window, so after any number of slots
t each source has had more than t w_i / W - 1 and fewer than t w_i / W + 1 blocks.  The weights are the targets themselves, as integers
of any size in the same proportions (each target's shortest decimal is taken as exact), so this holds for the true targets, for any
number of slots and sources.

The schedule repeats every W slots; the driver schedules W slots, or the mixture's length where that is less, by two heaps: a step for
each block of documents, of which it keeps the source only.  Blocks of documents take their slots by a join on (source, q mod the source's
subtasks in the schedule).

Documents are numbered within their source in the order of md5(doc_id), by counts of md5 prefixes and a window within each
prefix, so that no task holds a whole source.  The mixture runs until every source has been emitted whole; a source that its
target weight asks more of starts another epoch.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, table

#: Slots of a schedule of rounded weights, documents of a block, and the exponent of the default target weights.
SLOTS, BLOCK, TEMPER = 1000, 16, 0.9
#: Slots of a schedule that is broadcast.
BROADCAST = 1 << 22


def earliest_first(weights: dict[str, int]) -> Iterator[str]:
    """The source of each slot without end, earliest deadline first."""
    total, names = sum(weights.values()), sorted(weights)
    done = dict.fromkeys(names, 0)
    ready = [(-(-total // weights[s]), s) for s in names]
    heapq.heapify(ready)
    later: list[tuple[int, str]] = []
    t = 0
    while True:
        while later and later[0][0] <= t:
            s = heapq.heappop(later)[1]
            heapq.heappush(ready, (-(-(done[s] + 1) * total // weights[s]), s))
        deadline, s = heapq.heappop(ready)
        assert t < deadline
        done[s] += 1
        heapq.heappush(later, (done[s] * total // weights[s], s))
        t += 1
        yield s


def schedule(weights: dict[str, int], length: int | None = None) -> list[str]:
    """The source of each of the first ``length`` slots, of sum(weights) by default."""
    return [s for _, s in zip(range(sum(weights.values()) if length is None else length), earliest_first(weights))]


def exact_weights(target: dict[str, float]) -> dict[str, int]:
    """The least integers in the proportions of the targets' decimals."""
    parts = {s: Fraction(str(x)) for s, x in target.items()}
    if any(x <= 0 for x in parts.values()):
        raise ValueError("a source that has documents needs a weight above 0: the mixture ends when all of them are emitted")
    scale = math.lcm(*(x.denominator for x in parts.values()))
    out = {s: int(x * scale) for s, x in parts.items()}
    least = math.gcd(*out.values())
    return {s: w // least for s, w in out.items()}


def whole_weights(target: dict[str, float], slots: int = SLOTS) -> dict[str, int]:
    """Integer weights that add up to ``slots`` (to the number of sources where there are more), 1 at least: the largest remainders are
    rounded up, ties by name; what the ones take is taken from the heaviest."""
    slots = max(slots, len(target))
    total = sum(target.values())
    exact = {s: slots * x / total for s, x in target.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    by = sorted(exact, key=lambda s: (-(exact[s] - int(exact[s])), s))
    while sum(out.values()) < slots:
        for s in by[: slots - sum(out.values())]:
            out[s] += 1
    while sum(out.values()) > slots:
        out[max(out, key=lambda s: (out[s], s))] -= 1
    return out


def tempered(counts: dict[str, int], exponent: float = TEMPER) -> dict[str, float]:
    return {s: float(n) ** exponent for s, n in counts.items()}


def _name(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def numbered(rows: DataFrame, digits: int) -> DataFrame:
    """Adds __n: 0, 1, ... within each __source in the order of (md5(__id), __id, __tie)."""
    rows = rows.withColumn("__md5", F.md5(F.coalesce(F.col("__id").cast("string"), F.lit("")))).withColumn("__p", F.substring("__md5", 1, digits))
    count = rows.groupBy("__source", "__p").agg(F.count("*").alias("__c"))
    before = count.withColumn("__before", F.sum("__c").over(W.partitionBy("__source").orderBy("__p").rowsBetween(W.unboundedPreceding, -1))).select("__source", "__p", F.coalesce("__before", F.lit(0)).alias("__before"))
    own = F.row_number().over(W.partitionBy("__source", "__p").orderBy("__md5", "__id", "__tie")) - 1
    return rows.withColumn("__own", own).join(before, ["__source", "__p"]).withColumn("__n", F.col("__before") + F.col("__own")).drop("__own", "__before", "__md5", "__p")


def plan(rows: DataFrame, target: dict[str, float] | None, slots: int | None, block: int, exponent: float) -> tuple[DataFrame | None, DataFrame | None, dict[str, int]]:
    """The schedule as a table (__source, __k, __slot), its sources (__source, __w: subtasks in it, __blocks), and the mixture's length and the
    schedule's in slots."""
    counts = {r[0]: r[1] for r in rows.groupBy("__source").count().collect()}
    if not counts:
        return None, None, {}
    least = min(target.values()) if target else 0
    asked = {s: float(target.get(s, least)) for s in counts} if target else tempered(counts, exponent)
    weights = exact_weights(asked) if slots is None else whole_weights(asked, slots)
    blocks = {s: -(-n // block) for s, n in counts.items()}
    period = sum(weights.values())
    length = max(-(-blocks[s] * period // w) for s, w in weights.items())
    every = min(period, length)
    names = sorted(weights)
    number = {s: i for i, s in enumerate(names)}
    who = np.fromiter((number[s] for s in earliest_first(weights)), np.int32, every)
    w = np.bincount(who, minlength=len(names))
    by = np.argsort(who, kind="stable")
    k = np.empty(every, np.int64)
    k[by] = np.arange(every) - np.repeat(np.cumsum(w) - w, w)
    source = pa.DictionaryArray.from_arrays(pa.array(who), pa.array(names, pa.string())).cast(pa.string())
    places = rows.sparkSession.createDataFrame(pa.table({"__source": source, "__k": pa.array(k), "__slot": pa.array(np.arange(every))}))
    size = small(rows.sparkSession, [(s, int(w[number[s]]), blocks[s]) for s in names], "__source string, __w long, __blocks long")
    total = sum(counts.values())
    digits = next(d for d in range(1, 9) if 16**d * 2000 >= total or d == 8)
    return places, size, {"length": length, "every": every, "digits": digits}


def mixed(docs: DataFrame, target: dict[str, float] | None = None, slots: int | None = None, block: int = BLOCK, exponent: float = TEMPER, source_col: str = "source", payload: bool = False) -> DataFrame:
    """doc_id, source, epoch, block, slot, place: one row for each time that a document is emitted, in slot ``slot`` of the mixture
    at ``place`` of its block.  payload: the documents' own columns instead.

    target: weights by source, above 0, tempered counts (n ** exponent) by default; a source that the target lacks gets the least weight.
    The mixture is as long as its slowest source asks for: a large source of little weight means many epochs of the others.
    slots: round the targets to a schedule that repeats after so many slots; by default they are exact.
    Null sources are one source named ''.  Repeated rows and null ids are documents like others, and so are those of null, empty or very long
    texts: a block counts documents.  Ids of equal md5 (repeats) follow each other by their other columns' strings or hash, and rows that are
    equal in these too in any order, which doesn't show.  Ids are cast to long (under ANSI another kind of id raises).  Other columns
    don't matter, whatever their names.  An empty table gives an empty one.
    """
    names = [f"__c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    col = {c: F.col(n) for c, n in zip(docs.columns, names, strict=True)}
    tie = F.xxhash64(*names) if payload else F.struct(*[col[c].cast("string") for c in ("lang", "n_chars") if c in col], F.lit(0))
    row = [F.struct(*names).alias("__row")] if payload else []
    keys = own.select(_name(col[source_col]).alias("__source"), col["doc_id"].cast("long").alias("__id"), tie.alias("__tie"), *row)
    places, size, at = plan(keys.select("__source"), target, slots, block, exponent)
    if places is None:
        return docs if payload else keys.select(F.col("__id").alias("doc_id"), F.col("__source").alias("source"), *[F.lit(0).cast("long").alias(c) for c in ("epoch", "block", "slot", "place")])
    k = numbered(keys, at["digits"]).withColumn("__b", F.floor(F.col("__n") / block)).withColumn("place", F.col("__n") % block)
    per = at["every"]
    # epochs of a source within the mixture's length, rounded up to whole schedules; the exact limit is the filter on slot
    most = F.ceil(F.lit(-(-at["length"] // per)) * F.col("__w") / F.col("__blocks"))
    k = k.join(F.broadcast(size), "__source").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), most.cast("long") - 1)))
    k = k.withColumn("__q", F.col("__b") + F.col("epoch") * F.col("__blocks")).withColumn("__k", F.col("__q") % F.col("__w"))
    k = k.join(F.broadcast(places) if per <= BROADCAST else places, ["__source", "__k"])
    k = k.withColumn("slot", F.floor(F.col("__q") / F.col("__w")) * per + F.col("__slot")).where(F.col("slot") < at["length"])
    if payload:
        return k.select(*[F.col(f"__row.{n}").alias(c) for n, c in zip(names, docs.columns, strict=True)])
    return k.select(F.col("__id").alias("doc_id"), F.col("__source").alias("source"), "epoch", F.col("__b").alias("block"), "slot", F.col("place").cast("long").alias("place"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


QUERIES = {"op4_mixing": op4_mixing}
