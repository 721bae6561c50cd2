"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one node.  Nodes are dealt out to shards of about SHARD by a hash.  Each shard's graph is built in one task: levels by a
hash of the id, neighbours chosen for diversity, insertion and search in batches (numpy steps the beams of many
vectors at once).  Every node then queries its own shard and all later ones, so that every pair is searched for once, blocks of
queries against one graph in a task.  A task audits its beam's width by AUDIT of its queries and by AUDIT probes, which are vectors at
the threshold's likeness to nodes dealt over the whole shard, so that what the graph can't reach is noticed however rare near vectors are: both are
compared with all vectors of the shard, and while recall of either is under RECALL the beam is doubled.  A query whose beam is full of
hits is compared with all vectors.  A beam as wide as the shard is exhaustive, so this ends.  Cosines are taken again in double
precision.  Tasks answer with the number of links of each node and the least node that links lead to, not with pairs; components of these are
the classes.  Queries times shards grow with the square of the table over SHARD: that is the cost of asking every shard.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table
from .components import classes, spread
from .kernels import mix

THRESHOLD, SHARD, LINKS, BEAM, AUDIT, RECALL, BATCH, EXPAND = 0.95, 32_768, 12, 32, 256, 0.98, 512, 4
#: Tasks at least that search one graph in small tables.
PARALLEL = 4


def diverse(x: np.ndarray, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, links: int) -> np.ndarray:
    """Of each row's candidates (-1: none) at most ``links``: nearest first, those nearer to the row's vector than to any taken; free
    places go to the nearest of the rest."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    v = x[np.maximum(ids, 0)]
    between = v @ v.transpose(0, 2, 1)
    taken = np.zeros(ids.shape, bool)
    worst = np.full(ids.shape, -2.0, np.float32)  # likeness to what is taken
    for j in range(ids.shape[1]):
        ok = (ids[:, j] >= 0) & (sims[:, j] > worst[:, j]) & (taken.sum(1) < links)
        taken[:, j] = ok
        worst[ok] = np.maximum(worst[ok], between[ok, j, :])
    rank = np.where(ids < 0, 4, np.where(taken, 0, 1)) * ids.shape[1] * 2 + np.arange(ids.shape[1])
    order = np.argsort(rank, axis=1, kind="stable")[:, :links]
    return np.take_along_axis(ids, order, 1)


class Layer:
    """One level: ``near`` has the neighbours of each vector of the shard, -1 where there are fewer or the vector isn't on the level."""

    def __init__(self, n: int, links: int):
        self.near, self.links = np.full((n, 2 * links), -1, np.int32), links

    def search(self, x: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, likeness), best first, of each query's beam; entry: ids to begin at, -1 for none."""
        b, n = len(q), len(x)
        beam = min(beam, n)
        seen = np.zeros((b, n + 1), bool)
        seen[:, n] = True
        rows = np.arange(b)[:, None]
        ids = np.full((b, beam), -1, np.int64)
        sims = np.full((b, beam), -2.0, np.float32)
        done = np.ones((b, beam), bool)
        new = entry.astype(np.int64)
        live = np.arange(b)
        while True:
            new = np.where(new < 0, n, new)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = n
            new = np.where(seen[live[:, None], new], n, new)
            seen[live[:, None], new] = True
            s = np.einsum("bd,bkd->bk", q[live], x[np.minimum(new, n - 1)])
            s = np.where(new < n, s, np.float32(-2))
            al, asim = np.concatenate([ids[live], np.where(new < n, new, -1)], 1), np.concatenate([sims[live], s], 1)
            ad = np.concatenate([done[live], new >= n], 1)
            top = np.argpartition(-asim, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], done[live] = np.take_along_axis(al, top, 1), np.take_along_axis(asim, top, 1), np.take_along_axis(ad, top, 1)
            live = live[~done[live].all(1)]
            if not len(live):
                break
            open_ = np.where(done[live], np.float32(-3), sims[live])
            k = min(EXPAND, beam)
            pick = np.argpartition(-open_, k - 1, axis=1)[:, :k]
            at = np.where(np.take_along_axis(done[live], pick, 1), -1, np.take_along_axis(ids[live], pick, 1))
            done[live[:, None], pick] = True
            new = np.where(at[..., None] >= 0, self.near[np.maximum(at, 0)], -1).reshape(len(live), -1).astype(np.int64)
        order = np.argsort(-sims, axis=1, kind="stable")
        return ids[rows, order], sims[rows, order]

    def link(self, x: np.ndarray, new: np.ndarray, found: np.ndarray, sims: np.ndarray) -> None:
        """Puts vectors on the level: forward links to diverse candidates, and links back."""
        own = x[new] @ x[new].T
        np.fill_diagonal(own, -2)
        k = min(self.links, len(new))
        best = np.argpartition(-own, k - 1, axis=1)[:, :k]
        mates = np.where(np.take_along_axis(own, best, 1) > -2, new[best], -1)
        ids = np.concatenate([found, mates], 1)
        sims = np.concatenate([np.where(found >= 0, sims, -2), np.take_along_axis(own, best, 1)], 1).astype(np.float32)
        to = diverse(x, x[new], ids, sims, self.links)
        self.near[new, : to.shape[1]] = to
        a, b = np.repeat(new, to.shape[1]), to.ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(b)))
        for lo in range(0, len(first), BATCH):
            f, c = first[lo : lo + BATCH], count[lo : lo + BATCH]
            node = b[f]
            more = np.full((len(f), int(c.max())), -1, np.int64)
            within = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            more[np.repeat(np.arange(len(f)), c), within] = a[np.repeat(f, c) + within]
            cand = np.concatenate([self.near[node], more], 1)
            cand.sort(axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            s = np.where(cand >= 0, np.einsum("bd,bkd->bk", x[node], x[np.maximum(cand, 0)]), np.float32(-2))
            if cand.shape[1] > 4 * self.links:
                keep = np.argpartition(-s, 4 * self.links, axis=1)[:, : 4 * self.links]
                cand, s = np.take_along_axis(cand, keep, 1), np.take_along_axis(s, keep, 1)
            keep = diverse(x, x[node], cand, s, 2 * self.links)
            self.near[node] = -1
            self.near[node, : keep.shape[1]] = keep


class Graph:
    """The levels of one shard; ``x`` has vectors of length 1."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, links: int = LINKS, beam: int = 2 * BEAM):
        self.ids = ids
        level = np.zeros(len(ids), np.int64)
        h = mix(ids.astype(np.uint64) + np.uint64(77))
        for k in range(1, 8):
            level += (h % np.uint64(16**k) == 0) & (level == k - 1)
        self.levels: list[tuple[np.ndarray, Layer]] = []
        for k in range(int(level.max()) if len(ids) else 0, -1, -1):
            members = np.flatnonzero(level >= k)
            members = members[np.argsort(-level[members], kind="stable")]
            layer = Layer(len(ids), links)
            at = min(len(members), 2 * links)
            none = np.full((at, 1), -1, np.int64)
            layer.link(x, members[:at], none, np.full((at, 1), -2, np.float32))
            while at < len(members):
                new = members[at : at + min(BATCH, at)]
                found, sims = layer.search(x, x[new], self.entry(x, x[new], members[:at]), beam)
                layer.link(x, new, found[:, : 2 * links], sims[:, : 2 * links])
                at += len(new)
            self.levels.append((members, layer))

    def entry(self, x: np.ndarray, q: np.ndarray, members: np.ndarray | None = None) -> np.ndarray:
        """Where to begin on the level below those that there are."""
        levels = self.levels if members is not None else self.levels[:-1]
        start = (levels[0][0] if levels else (members if members is not None else self.levels[-1][0]))[:4]
        at = np.repeat(start[None, :], len(q), 0)
        for _, layer in levels:
            at = layer.search(x, q, at, 8)[0][:, :4]
        return at

    def search(self, x: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        return self.levels[-1][1].search(x, q, self.entry(x, q), beam)


def probes(x: np.ndarray, of: np.ndarray, likeness: float) -> np.ndarray:
    """Vectors of length 1 whose cosine with x[of] is the likeness."""
    v = np.random.Generator(np.random.PCG64(len(x))).normal(size=(len(of), x.shape[1])).astype(np.float32)
    v -= np.einsum("bd,bd->b", v, x[of])[:, None] * x[of]
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return np.float32(likeness) * x[of] + np.float32(max(1 - likeness * likeness, 0) ** 0.5) * v / np.maximum(length, 1e-9)


def _dealt(n: int, most: int) -> np.ndarray:
    return np.argsort(mix(np.arange(n, dtype=np.uint64)), kind="stable")[:most]


def passes(graph: Graph, x: np.ndarray, q: np.ndarray, truth: np.ndarray, least: np.float32, beam: int) -> bool:
    """Whether beams of this width find RECALL of the true partners; queries with full beams are left out, as they are compared with all vectors."""
    found = right = 0
    for lo in range(0, len(q), BATCH):
        ids, sims = graph.search(x, q[lo : lo + BATCH], beam)
        hits = (sims >= least) & (ids >= 0)
        open_, true = ~hits.all(1), truth[lo : lo + BATCH]
        found += int((np.take_along_axis(true, np.maximum(ids, 0), 1) & hits)[open_].sum())
        right += int(true[open_].sum())
    return found >= RECALL * right


def search_all(graph: Graph, x: np.ndarray, q: np.ndarray, own: np.ndarray, threshold: float = THRESHOLD, beam: int = BEAM) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(query, vector of the shard, beam's width) of the pairs of likeness >= threshold, block by block, by beams that pass the audit; own: the
    vector of the shard that each query is, -1 for none."""
    n, least = len(x), np.float32(threshold - 1e-6)
    some, at = _dealt(len(q), AUDIT), _dealt(n, AUDIT)
    truth = q[some] @ x.T >= least
    truth[np.flatnonzero(own[some] >= 0), own[some][own[some] >= 0]] = False
    near = probes(x, at, min(1.0, threshold + 1e-3))
    asked = [(q[some], truth), (near, near @ x.T >= least)]
    while beam < n and not all(passes(graph, x, v, true, least, beam) for v, true in asked):
        beam *= 2
    step = max(16, min(BATCH, BATCH * 64 // beam))
    for lo in range(0, len(q), step):
        rest = np.arange(lo, min(lo + step, len(q)))
        if beam < n:
            ids, sims = graph.search(x, q[rest], beam)
            hit = (sims >= least) & (ids >= 0)
            again = hit.all(1)
            a, b = np.nonzero(hit & ~again[:, None])
            yield rest[a], ids[a, b], beam
            rest = rest[again]
        if len(rest):
            a, b = np.nonzero(q[rest] @ x.T >= least)
            yield rest[a], b, beam


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _build(t: pa.Table) -> pa.Table:
    """The graph of one shard, in the order of (rep, s)."""
    t = t.sort_by([("rep", "ascending"), ("s", "ascending")])
    x = np.asarray(t["embedding"].combine_chunks().flatten(), dtype=np.float32).reshape(len(t), -1)
    graph = Graph(t["rep"].to_numpy(), unit(x))
    cols = {c: pa.array([v], pa.binary()) for c, v in (("reps", t["rep"].to_numpy().tobytes()), ("s", t["s"].to_numpy().tobytes()), ("copies", t["copies"].to_numpy().tobytes()), ("vectors", x.tobytes()), ("graph", pickle.dumps(graph)))}
    return pa.table({"dim": t["dim"][:1], "shard": t["shard"][:1], **cols})


_FOUND = "rep long, s long, root long, links long"


def _query(t: pa.Table, threshold: float, parts: int) -> pa.Table:
    """One graph (the row that has it) and a part of the vectors of one block, or of its own (then a pair is told by its later vector)."""
    none = pa.table({c: pa.array([], pa.int64()) for c in ("rep", "s", "root", "links")})
    dim, part, alone = t["dim"][0].as_py(), t["part"][0].as_py(), t["target"][0].as_py() == t["block"][0].as_py()
    home, asks = t.filter(pc.is_valid(t["graph"])), t.filter(pc.is_null(t["graph"]))
    if not len(home) or not (alone or len(asks)):
        return none

    def of(row: pa.Table) -> tuple[np.ndarray, ...]:
        return *(np.frombuffer(row[c][0].as_buffer(), np.int64) for c in ("reps", "s", "copies")), np.frombuffer(row["vectors"][0].as_buffer(), np.float32).reshape(-1, dim)

    reps, s, copies, raw = of(home)
    n = len(reps)
    if alone:
        mine = np.arange(part, n, parts)
        qraw, place, own = raw[mine], mine, mine
    else:
        qreps, qs, qcopies, qraw = of(asks)
        mine = np.arange(part, len(qreps), parts)
        qraw, place, own = qraw[mine], n + mine, np.full(len(mine), -1)
        reps, s, copies = np.concatenate([reps, qreps]), np.concatenate([s, qs]), np.concatenate([copies, qcopies])
    if not len(mine):
        return none
    links, root = np.zeros(len(reps), np.int64), np.argsort(np.argsort(reps, kind="stable"))
    for a, b, _ in search_all(pickle.loads(home["graph"][0].as_py()), unit(raw), unit(qraw), own, threshold):
        if alone:
            later = place[a] > b
            a, b = a[later], b[later]
        u, v = qraw[a].astype(np.float64), raw[b].astype(np.float64)
        ok = np.einsum("kd,kd->k", u, v) >= threshold * np.sqrt(np.einsum("kd,kd->k", u, u) * np.einsum("kd,kd->k", v, v))
        spread(links, root, place[a[ok]], b[ok], copies)
    root = np.sort(reps)[root]
    has = np.flatnonzero(links)
    return pa.table({"rep": pa.array(reps[has]), "s": pa.array(s[has]), "root": pa.array(root[has]), "links": pa.array(links[has])})


def near_classes(vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, class_id, n_links: one row for each id.

    n_links is the number of other ids whose vector has a cosine >= threshold with the id's, class_id the least id that links lead to (its own
    for an id without a link).

    Null ids, null or empty vectors, and vectors of length 0 or with a null or non-finite component are left out; ids are cast to long
    (under ANSI another kind of id raises).  Vectors of different dimensions aren't compared; very long ones only take more room.  A cosine
    that equals the threshold is a link.  Rows that repeat an id with the same vector are one; with other vectors each takes part, they are
    one class, and their links are summed.  Other columns don't matter, whatever their names.  An empty table gives an empty table.
    """
    e = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<float>").alias("embedding")).dropna()
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    e = e.where((F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda v: v != 0))
    e = e.withColumns({"s": F.xxhash64("embedding"), "s2": F.xxhash64(F.lit(1), "embedding")})
    members = e.select("s", "s2", "id").distinct()
    copies = members.groupBy("s", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    node = e.groupBy("s", "s2").agg(F.min_by("embedding", "id").alias("embedding")).join(copies, ["s", "s2"])
    node = checkpoint(node.select("rep", "s", "s2", "copies", "embedding", F.size("embedding").alias("dim")))
    shards = max(1, -(-node.count() // shard))
    parts = max(1, PARALLEL // shards)
    built = node.select("dim", F.pmod(F.xxhash64("rep", "s"), F.lit(shards)).cast("int").alias("shard"), "rep", "s", "copies", "embedding")
    built = checkpoint(built.groupBy("dim", "shard").applyInArrow(_build, "dim int, shard int, reps binary, s binary, copies binary, vectors binary, graph binary"))
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    data = ["reps", "s", "copies", "vectors"]
    home = built.select("dim", F.col("shard").alias("target"), F.explode(F.sequence("shard", F.lit(shards - 1))).alias("block"), *data, "graph")
    ask = built.where("shard > 0").select("dim", F.explode(F.sequence(F.lit(0), F.col("shard") - 1)).alias("target"), F.col("shard").alias("block"), *data, F.lit(None).cast("binary").alias("graph"))
    both = home.unionByName(ask).select("dim", "target", "block", part, *data, "graph")
    found = checkpoint(both.groupBy("dim", "target", "block", "part").applyInArrow(lambda t: _query(t, threshold, parts), _FOUND))
    every = members.join(node.select("s", "s2", "rep", "copies"), ["s", "s2"]).select("id", "rep", "s", "copies")
    return classes(every, found, alone=True).withColumnRenamed("id", "vec_id")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "embeddings"))


SQL = {
    "op10_embedding_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT DISTINCT vec_id AS id, vec_id AS seen FROM v UNION SELECT id, b FROM reach JOIN link ON a = seen)
SELECT id AS vec_id, min(seen) AS class_id, (SELECT count(*) FROM link WHERE a = id) AS n_links FROM reach GROUP BY id
"""
}
QUERIES = {"op10_embedding_near_dedup": op10_embedding_near_dedup}
