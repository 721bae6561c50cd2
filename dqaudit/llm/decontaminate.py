"""Benchmark items inside documents: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item's Jaccard similarity with a long document says nothing, so documents are compared piecewise: items are
partitioned by their number of shingles, [S, 2S) for each power of two S, and for each partition a document is a row of
windows of 3 S shingles, one every S, so that an item's passage lies in one window whole.  Containment t then means a
Jaccard similarity of t S / (3 S + S - t S) = 0.25 at least (t = 0.8), and with HASHES = 32 one-row bands a passage is missed
with a chance of 0.75^32 = 1e-4.  Window minima are minima of block minima, so all partitions share one pass over the
hashes.  A document with a band in common is verified against the item's whole shingle set in the task that holds
it: no shuffle at all.  The items' signatures go to every task; benchmark tables of more than CHUNK items are searched
in several passes of at most CHUNK each, so what is sent is bounded.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .kernels import SLICE, U64, Tokens, buffers, kept, mix, slices, tidy

SHINGLE, CONTAINMENT, HASHES = 5, 0.8, 32
#: Items that are searched for in one pass.
CHUNK = 50_000
_A = np.random.Generator(np.random.PCG64(7)).integers(1, 2**62, HASHES, dtype=np.uint64) * U64(2) + U64(1)


class Items:
    """Shingles and signatures of some benchmark items, by length of shingle and partition of sizes."""

    def __init__(self, ids: list, texts: pa.Array, threshold: float):
        self.threshold = threshold
        self.shingles: list[np.ndarray] = []
        self.ids: list = []
        keys: dict[tuple[int, int], list] = defaultdict(list)
        buf, offs = buffers(texts)
        for lo, hi in slices(offs):
            tok = Tokens(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            for i in range(hi - lo):
                a, z = int(tok.of[i]), int(tok.of[i + 1])
                if a == z:
                    continue
                n = min(SHINGLE, z - a)
                own = tok.low[offs[lo + i] - offs[lo] : offs[lo + i + 1] - offs[lo]]
                g = np.unique(Tokens(own, np.array([0, len(own)])).grams(n)[0])
                self.ids.append(ids[lo + i])
                self.shingles.append(g)
                keys[n, len(g).bit_length() - 1].append((len(self.ids) - 1, (g[:, None] * _A).min(0)))
        self.parts = {}
        for (n, c), rows in sorted(keys.items()):
            which = np.repeat(np.array([i for i, _ in rows]), HASHES)
            sig = self.key(np.stack([s for _, s in rows])).ravel()
            order = np.argsort(sig, kind="stable")
            bits = max(16, int(len(sig)).bit_length() + 4)
            maybe = np.zeros(1 << bits, bool)
            maybe[(sig >> U64(64 - bits)).astype(np.int64)] = True
            self.parts[n, c] = (sig[order], which[order], maybe, U64(64 - bits))

    @staticmethod
    def key(minima: np.ndarray) -> np.ndarray:
        return mix(minima ^ np.arange(HASHES, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))

    def candidates(self, g: np.ndarray, doc: np.ndarray, n: int) -> set[tuple[int, int]]:
        """(text, item) of which a window shares a band; g: shingle hashes in the order of the texts, doc: the text of each."""
        out: set[tuple[int, int]] = set()
        cs = [c for m, c in self.parts if m == n]
        if not len(g) or not cs:
            return out
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        size = np.diff(np.append(first, len(g)))
        level, s = None, 1 << min(cs)
        for c in range(min(cs), max(cs) + 1):
            if level is None:
                blocks = -(-size // s)
                of = np.repeat(np.arange(len(first)), blocks)
                within = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                at = first[of] + within * s
                level = np.empty((len(at), HASHES), np.uint64)
                for k in range(HASHES):
                    level[:, k] = np.minimum.reduceat(g * _A[k], at)
            else:  # a block of twice the size is two neighbours of one text
                even = np.flatnonzero(within % 2 == 0)
                has = np.zeros(len(even), bool)
                nxt = np.minimum(even + 1, len(of) - 1)
                has = (even + 1 < len(of)) & (of[nxt] == of[even])
                level = np.where(has[:, None], np.minimum(level[even], level[nxt]), level[even])
                of, within = of[even], within[even] // 2
            if c not in cs:
                continue
            window = level.copy()
            for d in (1, 2):
                ok = np.flatnonzero(of[d:] == of[:-d])
                window[ok] = np.minimum(window[ok], level[ok + d])
            sig, which, maybe, shift = self.parts[n, c]
            key = self.key(window)
            hit = np.flatnonzero(maybe[(key >> shift).astype(np.int64)])
            k = key.ravel()[hit]
            lo, hi = np.searchsorted(sig, k), np.searchsorted(sig, k, "right")
            for h, a, z in zip(hit[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                d = int(doc[first[of[h // HASHES]]])
                out.update((d, int(i)) for i in which[a:z])
        return out

    def search(self, col: pa.Array) -> list[tuple[int, int, float]]:
        """(text, item, containment) of the pairs that reach the threshold."""
        found = []
        buf, offs = buffers(col)
        for lo, hi in slices(offs, SLICE):
            tok = Tokens(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            for n in sorted({n for n, _ in self.parts}):
                g, doc = tok.grams(n)
                full = int(np.maximum(np.diff(tok.of) - n + 1, 0).sum())
                g, doc = g[:full], doc[:full]  # texts of fewer than n tokens have no shingle of n
                held: dict[int, np.ndarray] = {}
                for d, i in sorted(self.candidates(g, doc, n)):
                    if d not in held:
                        held = {d: np.unique(g[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")])}
                    own = self.shingles[i]
                    at = np.minimum(np.searchsorted(held[d], own), len(held[d]) - 1)
                    share = float((held[d][at] == own).sum()) / len(own)
                    if share >= self.threshold:
                        found.append((lo + d, i, share))
        return found


def passes(benchmark: DataFrame, threshold: float, chunk: int) -> Iterator[Items]:
    rows = benchmark.select(benchmark["item_id"].cast("long").alias("i"), benchmark["text"].alias("t")).where("t IS NOT NULL")
    n = -(-rows.count() // chunk)
    for k in range(n):
        got = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).toArrow()
        yield Items(got["i"].to_pylist(), got["t"], threshold)


_OUT = "doc_id long, item_id long, containment double, shingles int"


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, item_id, containment, shingles: the pairs of which the document holds at least ``threshold`` of the item's distinct
    shingles of 5 tokens; an item of 1 to 4 tokens is one shingle of all of them.

    A null or token-free text on either side is in no pair; null ids are kept as null; repeated rows are reported
    once each; a very long document is searched whole; a containment that equals the threshold counts.  Ids are cast to long (under ANSI
    another kind of id raises).  Other columns of either table don't matter, whatever their names.  With no documents, no benchmark items,
    or none with tokens, the result is empty.
    """
    src = docs.select(docs["doc_id"].cast("long").alias("__id"), docs["text"].alias("__text"))
    out = None
    for items in passes(benchmark, threshold, chunk):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = items.search(batch.column(1))
                tidy()
                d = pa.array([d for d, _, _ in got], pa.int64())
                yield pa.record_batch([batch.column(0).take(d), pa.array([items.ids[i] for _, i, _ in got], pa.int64()), pa.array([s for _, _, s in got], pa.float64()), pa.array([len(items.shingles[i]) for _, i, _ in got], pa.int32())], names=["doc_id", "item_id", "containment", "shingles"])

        part = src.mapInArrow(run, _OUT)
        out = part if out is None else out.unionByName(part)
    return src.sparkSession.createDataFrame([], _OUT) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT, chunk: int = CHUNK) -> DataFrame:
    """The documents in no such pair, with all columns, one scan for each CHUNK of items; see contaminated for the edge cases."""
    at = docs.columns.index("text")
    for items in passes(benchmark, threshold, chunk):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                keep[[d for d, _, _ in items.search(batch.column(at))]] = False
                tidy()
                yield from kept(batch, keep)

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_W = "regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10ffff}]+')"
SQL = {
    "op8_decontamination": f"""
WITH i AS (SELECT item_id, {_W} AS w FROM benchmark), d AS (SELECT doc_id, {_W} AS w FROM documents),
ig AS (SELECT DISTINCT item_id, n, array_to_string(w[j:j + n - 1], ' ') AS gram FROM (
  SELECT item_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS j FROM i WHERE len(w) > 0)),
size AS (SELECT item_id, count(*)::INT AS shingles FROM ig GROUP BY item_id),
dg AS (SELECT DISTINCT doc_id, n, array_to_string(w[j:j + n - 1], ' ') AS gram FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM d, (SELECT DISTINCT n FROM ig) WHERE len(w) >= n))
SELECT doc_id, item_id, count(*) / any_value(shingles)::DOUBLE AS containment, any_value(shingles) AS shingles
FROM ig JOIN dg USING (n, gram) JOIN size USING (item_id) GROUP BY doc_id, item_id HAVING count(*) / any_value(shingles)::DOUBLE >= 0.8
"""
}
QUERIES = {"op8_decontamination": op8_decontamination}
