"""N-gram Jaccard self-join of texts by a prefix tree over globally ordered n-gram sets.

Every text is a set of word n-grams.  The global order puts rare n-grams first: (document frequency, hash).
Plan:

1. One scan packs each part's (n-gram hash, text number) pairs (see ``exchange``); a bucket's reducer counts document frequencies and
   answers with the n-grams that at least two texts have.  An n-gram of several texts of a part travels once, with their number, and its
   texts stay with the part's own row; so an n-gram that a third of all texts have costs its reducer one entry for each part.  An n-gram
   of one text only comes first in the order and matches nothing, so of the rest only its number matters.
2. A text of n n-grams of which fewer than ceil(t n) are shared can't reach the threshold t; it is dropped.
   Texts with the same set are joined to one.
3. Two sets within the threshold share an n-gram among the first n - ceil(t n) + 1 of either.  Texts that do are
   linked, first within a part, so that again a frequent n-gram is one entry for each part.
4. Each connected component of the links goes to one trie.  A component of more than UNIT bytes is cut into classes of sizes, of which only
   neighbours can match, and these by hash into blocks; each pair of blocks is a task's work, so no task grows with the component.
5. The trie holds ordered sets with shared beginnings joined.  A walk carries, for all other
   texts at once, how much of the path each contains, so that this partial overlap is counted once for all
   texts below a node; texts are dropped from a subtree when the overlap so far and the least of what remains on
   either side can't reach the threshold.  What arrives at a leaf is exact.
6. A task answers with the number of links of each set and its least linked set, not with pairs; components of these are the classes.

Every text is compared with every other that can match, whatever a group's size.  48 bits of each n-gram's hash are
kept: for two given texts of 600 n-grams the chance of any false match is about 1e-9.

Near copies with a few changed words in a hundred mostly have a Jaccard similarity of 5-grams of 0.4 to 0.9, as each changed word
takes five of them; nearly all pairs of unrelated texts are below 0.15.  THRESHOLD lies between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from .common import buckets, checkpoint, drop_ids, release, table
from .components import classes, components, spread
from .kernels import SLICE, U64, mix, ranges, tidy, token_slices

THRESHOLD, N = 0.4, 5
#: Bytes of the sets of one block of a large component.
UNIT = 2 << 20
#: Tokens of a trie path that are walked between two looks at the bounds.
STRIDE = 64
#: Texts of a part whose n-grams are mixed at once.
TEXTS = 1024
_H48 = U64((1 << 48) - 1)
_FORWARD = "bucket int, part long, keys binary, many binary, own binary, ids binary, sizes binary, set1 binary, set2 binary"
_BACK = "part long, ranks binary, idx binary, many binary, own binary, ids binary, sizes binary, set1 binary, set2 binary"
_LEFT = "doc_id long, n int, set1 long, set2 long, ranks binary"
_HEAD = ("own", "ids", "sizes", "set1", "set2")


def need(n: int | np.ndarray, t: float) -> int | np.ndarray:
    """Least number of shared n-grams with which a set of n can reach Jaccard t."""
    return np.ceil(np.asarray(n) * t - 1e-9).astype(np.int64)


def _least_overlap(a: int | np.ndarray, b: int | np.ndarray, t: float) -> np.ndarray:
    return np.ceil((np.asarray(a) + np.asarray(b)) * t / (1 + t) - 1e-9).astype(np.int64)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _send(batches: Iterator[pa.RecordBatch], n: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Map side: columns __id, __text.  keys: hash and text of the n-grams of one text, many: hash and number of texts of the others, own: hash
    and text of these."""
    held: list[np.ndarray] = []  # 16 bits of the text's number, 48 of the n-gram's hash
    ids: list[np.ndarray] = []
    items = texts = flush = 0
    most = X.part_items(n_buckets)

    def out() -> pa.RecordBatch:
        nonlocal held, ids, items, texts, flush
        part = X.part_number(flush)
        keys = np.concatenate(held)
        held = []
        keys.sort()
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        at = np.searchsorted(keys, np.arange(texts + 1, dtype=np.uint64) << U64(48))
        sizes = np.diff(at).astype(np.int32)
        s1, s2 = np.zeros(texts, np.uint64), np.zeros(texts, np.uint64)
        for lo in range(0, texts, TEXTS):  # some texts at once, as these take several times the keys' bytes
            hi = min(texts, lo + TEXTS)
            h48 = keys[at[lo] : at[hi]] << U64(16)
            has = lo + np.flatnonzero(sizes[lo:hi])
            if len(has):
                s1[has] = np.add.reduceat(mix(h48 + U64(11)), at[has] - at[lo])
                s2[has] = np.add.reduceat(mix(h48 + U64(29)), at[has] - at[lo])
            keys[at[lo] : at[hi]] = h48 | np.repeat(np.arange(lo, hi, dtype=np.uint64), sizes[lo:hi])
        keys.sort()
        # an n-gram of one text differs from both neighbours
        same = (keys[1:] & ~X.IDX) == (keys[:-1] & ~X.IDX)
        after, before = np.append(same, False)[: len(keys)], np.append(False, same)[: len(keys)]
        own = keys[after | before]
        many = own & ~X.IDX
        first = _starts(many)
        many = many[first] | np.diff(np.append(first, len(own))).astype(np.uint64)
        keys = keys[~(after | before)]
        del same, after, before
        rows = [(b, part, k, None, None, None, None, None, None) for b, k in X.cut(keys, n_buckets)]
        del keys
        rows += [(b, part, None, k, None, None, None, None, None) for b, k in X.cut(many, n_buckets)]
        rows.append((part % n_buckets, part, None, None, own.tobytes(), np.concatenate(ids).tobytes(), sizes.tobytes(), s1.tobytes(), s2.tobytes()))
        ids, items, texts, flush = [], 0, 0, flush + 1
        cols = list(zip(*rows, strict=True))
        del rows
        kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 7
        got = pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _FORWARD.split(", ")])
        del cols
        tidy()
        return got

    for batch in batches:
        batch = batch.filter(batch.column(0).is_valid())
        own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, tok in token_slices(batch.column(1), SLICE):
            g, d = tok.grams(n)
            g >>= U64(16)
            k = len(tok.offs) - 1
            at = 0
            while at < k:
                if texts >= X.PART_TEXTS or items >= most:
                    yield out()
                hi = min(k, at + X.PART_TEXTS - texts)
                mine = (d >= at) & (d < hi)
                held.append(g[mine] | (d[mine] - at + texts).astype(np.uint64) << U64(48))
                ids.append(own[lo + at : lo + hi])
                items, texts, at = items + int(mine.sum()), texts + hi - at, hi
    if texts:
        yield out()


def _count(t: pa.Table) -> pa.Table:
    """One bucket: document frequencies; answers each part with its n-grams of frequency 2 or more."""
    heads = t.filter(pc.is_valid(t["ids"]))
    one, many = t.filter(pc.is_valid(t["keys"])), t.filter(pc.is_valid(t["many"]))
    blobs = [np.frombuffer(k.as_buffer(), np.uint64) for k in one["keys"]]
    counted = [np.frombuffer(k.as_buffer(), np.uint64) for k in many["many"]]
    every = np.sort(np.concatenate([np.zeros(0, np.uint64), *((b & ~X.IDX) | U64(1) for b in blobs), *counted]))
    values = every & ~X.IDX
    first = _starts(values)
    counts = np.add.reduceat(every & X.IDX, first) if len(first) else np.zeros(0, np.uint64)
    first, counts = first[counts > 1], counts[counts > 1]
    values = values[first]
    ranks = (np.minimum(counts, U64(0xFFFF)) << U64(48)) | (values >> U64(16))
    rows = []
    for part, b in zip(one["part"].to_pylist(), blobs, strict=True):
        at = X.lookup(values, b & ~X.IDX)
        own = at >= 0
        if own.any():
            rows.append((part, ranks[at[own]].tobytes(), (b[own] & X.IDX).astype(np.uint16).tobytes(), None))
    for part, b in zip(many["part"].to_pylist(), counted, strict=True):
        rows.append((part, None, None, ranks[X.lookup(values, b & ~X.IDX)].tobytes()))
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    back = {"part": pa.array(cols[0], pa.int64()), **{c: pa.array(x, pa.binary()) for c, x in zip(("ranks", "idx", "many"), cols[1:], strict=True)}}
    back = pa.table(back | {c: pa.nulls(len(rows), pa.binary()) for c in _HEAD})
    none = pa.nulls(len(heads), pa.binary())
    return pa.concat_tables([back, pa.table({"part": heads["part"], "ranks": none, "idx": none, "many": none, **{c: heads[c] for c in _HEAD}})])


def _gather(t: pa.Table, threshold: float) -> pa.Table:
    """One part: its texts that can still match, each with its shared n-grams in the global order."""

    def all_of(name: str, kind: type) -> np.ndarray:
        got = [np.frombuffer(x.as_buffer(), kind) for x in t[name] if x.is_valid]
        return np.concatenate(got) if got else np.zeros(0, kind)

    ids, sizes, s1, s2 = all_of("ids", np.int64), all_of("sizes", np.int32), all_of("set1", np.int64), all_of("set2", np.int64)
    ranks, idx = all_of("ranks", np.uint64), all_of("idx", np.uint16).astype(np.int64)
    many, own = all_of("many", np.uint64), all_of("own", np.uint64)
    if len(own):
        by = np.argsort(many & _H48)
        at = np.searchsorted((many & _H48)[by], own >> U64(16))
        ranks, idx = np.concatenate([ranks, many[by[at]]]), np.concatenate([idx, (own & X.IDX).astype(np.int64)])
    shared = np.bincount(idx, minlength=len(ids))
    left = (sizes > 0) & (shared >= need(sizes, threshold))
    keep = left[idx] if len(idx) else np.zeros(0, bool)
    ranks, idx = ranks[keep], idx[keep]
    order = np.lexsort((ranks, idx))
    ranks, idx = ranks[order], idx[order]
    which = np.flatnonzero(left)
    lo, hi = np.searchsorted(idx, which), np.searchsorted(idx, which, "right")
    rows = [ranks[a:b].tobytes() for a, b in zip(lo, hi, strict=True)]
    return pa.table({"doc_id": pa.array(ids[which]), "n": pa.array(sizes[which]), "set1": pa.array(s1[which]), "set2": pa.array(s2[which]), "ranks": pa.array(rows, pa.binary())})


_POSTS = "bucket int, tokens binary, ids binary"


def _posts(batches: Iterator[pa.RecordBatch], threshold: float, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Columns rep, n, ranks.  The n-grams within the sets' prefixes, each with the least id that has it here, and (without n-grams) the pairs of
    ids that share one here."""
    tokens: list[np.ndarray] = []
    ids: list[np.ndarray] = []
    items = 0

    def out() -> pa.RecordBatch:
        nonlocal tokens, ids, items
        tok, own = np.concatenate(tokens), np.concatenate(ids)
        order = np.lexsort((own, tok))
        tok, own = tok[order], own[order]
        first = _starts(tok)
        count = np.diff(np.append(first, len(tok)))
        pairs = np.stack([np.repeat(own[first], count), own], 1)
        several = np.ones(len(tok), bool)
        several[first] = False
        pairs = np.unique(pairs[several], axis=0)
        keys = tok[first]
        e = X.edges(keys, n_buckets, 0)
        rows = [(b, keys[e[b] : e[b + 1]].tobytes(), own[first[e[b] : e[b + 1]]].tobytes()) for b in np.flatnonzero(e[:-1] < e[1:]).tolist()]
        if len(pairs):
            rows.append((int(pairs[0, 0]) % n_buckets, None, pairs.tobytes()))
        tokens, ids, items = [], [], 0
        cols = list(zip(*rows, strict=True)) if rows else [()] * 3
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "tokens", "ids"])

    for batch in batches:
        for doc, n, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            r = np.frombuffer(r.as_buffer(), np.uint64)
            k = min(len(r), max(0, n - int(need(n, threshold)) + 1 - (n - len(r))))
            # hashes spread the n-grams over the buckets evenly, where ranks begin with the frequency
            tokens.append(r[:k] << U64(16))
            ids.append(np.full(k, doc, np.int64))
            items += k
            if items >= X.PART_ITEMS:
                yield out()
    if items:
        yield out()


def _linked(t: pa.Table) -> pa.Table:
    """One bucket of _posts: pairs (least id, id) that share an n-gram; (id, id) too, where one id has it in two sets."""
    posts, pairs = t.filter(pc.is_valid(t["tokens"])), t.filter(pc.is_null(t["tokens"]))
    tok = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_buffer(), np.uint64) for x in posts["tokens"])])
    own = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_buffer(), np.int64) for x in posts["ids"])])
    order = np.lexsort((own, tok))
    tok, own = tok[order], own[order]
    first = _starts(tok)
    several = np.ones(len(tok), bool)
    several[first] = False
    found = np.stack([np.repeat(own[first], np.diff(np.append(first, len(tok)))), own], 1)[several]
    found = np.concatenate([found, *(np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2) for x in pairs["ids"])])
    found = np.unique(found, axis=0) if len(found) else found
    return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})


class Trie:
    """Ordered sets with shared beginnings joined; a node is a run of tokens and an interval of the sorted sets."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.order = order
        self.sets = [sets[i] for i in order]
        lcp = np.zeros(len(sets) + 1, np.int64)
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
            lcp[i] = differ[0] if len(differ) else k
        self.lcp = lcp

    def children(self, lo: int, hi: int, depth: int) -> Iterator[tuple[int, int, int]]:
        """(lo, hi, depth of its end) of the nodes below the interval [lo, hi) that has depth tokens in common."""
        at = lo
        cuts = (np.flatnonzero(self.lcp[lo + 1 : hi] == depth) + lo + 1).tolist() + [hi]
        for c in cuts:
            yield at, c, len(self.sets[at]) if c - at == 1 else int(self.lcp[at + 1 : c].min())
            at = c


def trie_join(left: list[np.ndarray], left_n: np.ndarray, right: list[np.ndarray] | None, right_n: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the pairs within the threshold; right None: pairs i, j of left, each once."""
    trie = Trie(left)
    own = right is None
    probes = trie.sets if own else right
    tree_n = np.asarray(left_n)[trie.order]
    probe_n = tree_n if own else np.asarray(right_n)
    sizes = np.array([len(p) for p in probes], np.int64)
    who = np.repeat(np.arange(len(probes)), sizes)
    tokens = np.concatenate(probes) if len(probes) else np.zeros(0, np.uint64)
    by = np.argsort(tokens, kind="stable")
    tokens, who = tokens[by], who[by]
    lens, place = np.array([len(s) for s in trie.sets], np.int64), np.array(trie.order, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def walk(lo: int, hi: int, start: int, end: int, alive: np.ndarray, overlap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        path = trie.sets[lo]
        least_n, longest = int(tree_n[lo:hi].min()), int(lens[lo:hi].max())
        while True:
            stop = min(end, start + STRIDE)
            if stop > start:
                run = path[start:stop]
                a, b = np.searchsorted(tokens, run), np.searchsorted(tokens, run, "right")
                at = np.repeat(a, b - a) + ranges(b - a)
                overlap = overlap + np.bincount(who[at], minlength=len(probes))[alive]
                last = run[-1]
                # what a probe has beyond the last token of the path, and what the deepest set below has
                rest = np.array([len(probes[p]) - int(np.searchsorted(probes[p], last, "right")) for p in alive.tolist()], np.int64) if len(alive) <= 8 else _beyond(tokens, who, last, len(probes))[alive]
            else:
                rest = sizes[alive]
            ok = overlap + np.minimum(rest, longest - stop) >= _least_overlap(least_n, np.maximum(probe_n[alive], 0), threshold)
            alive, overlap = alive[ok], overlap[ok]
            start = stop
            if start >= end or not len(alive):
                return alive, overlap

    stack = [(lo, hi, 0, end, np.arange(len(probes)), np.zeros(len(probes), np.int64)) for lo, hi, end in trie.children(0, len(trie.sets), 0)]
    while stack:
        lo, hi, start, end, alive, overlap = stack.pop()
        if own:
            later = alive > lo
            alive, overlap = alive[later], overlap[later]
        alive, overlap = walk(lo, hi, start, end, alive, overlap)
        if not len(alive):
            continue
        if hi - lo == 1:
            good = overlap >= _least_overlap(tree_n[lo], probe_n[alive], threshold)
            found.append((np.full(int(good.sum()), trie.order[lo]), place[alive[good]] if own else alive[good]))
        else:
            stack += [(a, b, end, stop, alive, overlap) for a, b, stop in trie.children(lo, hi, end)]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(i for i, _ in found)]), np.concatenate([none, *(j for _, j in found)])


def _beyond(tokens: np.ndarray, who: np.ndarray, last: np.uint64, n: int) -> np.ndarray:
    return np.bincount(who[np.searchsorted(tokens, last, "right") :], minlength=n)


_WORK = "rep long, s long, root long, links long"


def _join(t: pa.Table, threshold: float) -> pa.Table:
    """One trie: rep, s of each set that is linked, the number of ids of the sets that it is linked to here, and the least rep that links lead
    to here."""
    side = t["side"].to_numpy()
    rep, n, copies = t["rep"].to_numpy(), t["n"].to_numpy().astype(np.int64), t["copies"].to_numpy()
    sets = [np.frombuffer(r.as_buffer(), np.uint64) for r in t["ranks"]]
    one = side[0] == 0
    a, b = np.flatnonzero(side <= 1), np.flatnonzero(side == 2)
    if not one and not (len(a) and len(b)):
        return pa.table({c: pa.array([], pa.int64()) for c in ("rep", "s", "root", "links")})
    i, j = trie_join([sets[x] for x in a], n[a], None if one else [sets[x] for x in b], None if one else n[b], threshold)
    i, j = a[i], (a if one else b)[j]
    links, root = np.zeros(len(rep), np.int64), np.argsort(np.argsort(rep, kind="stable"))
    spread(links, root, i, j, copies)
    root = np.sort(rep)[root]
    own = np.flatnonzero(links)
    return pa.table({"rep": pa.array(rep[own]), "s": t["s"].take(pa.array(own)), "root": pa.array(root[own]), "links": pa.array(links[own])})


def _units(one: DataFrame, comp: DataFrame, threshold: float) -> DataFrame:
    """The sets of each trie: component, unit (classes and blocks), side (0: all sets with each other, 1 with 2) and the columns of one.  A
    component within UNIT bytes is one trie; of a larger one each pair of blocks whose sizes can match."""
    cls = F.floor(F.log(F.col("n")) / float(-np.log(threshold)) + 1e-9).cast("int") if threshold < 1 else F.col("n")
    # the sets themselves travel only once it is known where to
    own = checkpoint(one.select("rep", "s", cls.alias("cls"), F.octet_length("ranks").alias("bytes")).join(comp.withColumnRenamed("id", "rep"), "rep"))
    size = own.groupBy("component", "cls").agg(F.sum("bytes").alias("bytes"))
    large = size.groupBy("component").agg(F.sum("bytes").alias("all")).where(F.col("all") > UNIT).select("component")
    size = checkpoint(size.join(large, "component").select("component", "cls", F.ceil(F.col("bytes") / UNIT).cast("int").alias("blocks")))
    small = own.join(size.select("component").distinct(), "component", "left_anti").select("component", F.lit("").alias("unit"), F.lit(0).alias("side"), "rep", "s")
    sized = own.join(size, ["component", "cls"]).withColumn("block", F.pmod(F.xxhash64("rep", "s"), F.col("blocks")).cast("int"))
    up = size.select("component", (F.col("cls") - 1).alias("cls"), F.col("blocks").alias("above"))
    down = size.select("component", (F.col("cls") + 1).alias("cls"), F.col("blocks").alias("below"))
    sized = sized.join(up, ["component", "cls"], "left").join(down, ["component", "cls"], "left")
    c, k = F.col("cls"), F.col("block")

    def to(i, j, side):
        return F.struct(F.concat_ws("-", *i, *j).alias("unit"), side.cast("int").alias("side"))

    first = F.lit(0)
    within = F.transform(F.sequence(first, F.col("blocks") - 1), lambda j: to((c, F.least(k, j)), (c, F.greatest(k, j)), F.when(j == k, 0).when(k < j, 1).otherwise(2)))
    above = F.when(F.col("above").isNotNull(), F.transform(F.sequence(first, F.col("above") - 1), lambda j: to((c, k), (c + 1, j), F.lit(1))))
    below = F.when(F.col("below").isNotNull(), F.transform(F.sequence(first, F.col("below") - 1), lambda j: to((c - 1, j), (c, k), F.lit(2))))
    none = F.array().cast("array<struct<unit:string,side:int>>")
    sized = sized.select("component", F.explode(F.concat(within, F.coalesce(above, none), F.coalesce(below, none))).alias("__to"), "rep", "s")
    routed = small.unionByName(sized.select("component", "__to.unit", "__to.side", "rep", "s"))
    return one.select("rep", "s", "n", "copies", "ranks").join(routed, ["rep", "s"])


def ngram_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, class_id, n_links: one row for each id that has a link.

    Two ids are linked where the Jaccard similarity of their texts' n-gram sets is threshold or more; n_links is the number of other ids that
    an id is linked to, class_id the least id that links lead to.  All links count, those between copies and between different texts.

    Rows with a null id are left out; ids are cast to long (under ANSI another kind of id raises).  A null, empty or token-free text has no
    n-grams and no link; a text of 1 to n - 1 tokens is one n-gram of all its tokens; very long texts count with all their n-grams.  A
    similarity that equals the threshold is a link.  Rows that repeat an id with the same n-grams are one; an id with different texts takes
    part with each of them, is one class, and its links are summed over them (texts alike of one id are linked as well).  Other columns don't
    matter, whatever their names.  An empty table gives an empty table.
    """
    src = docs.select(docs[id_col].cast("long").alias("__id"), docs[text_col].alias("__text"))
    nb = buckets(src, bucket_bytes)
    sent = src.mapInArrow(lambda it: _send(it, n, nb), _FORWARD)
    back = sent.groupBy("bucket").applyInArrow(_count, _BACK)
    left = checkpoint(back.groupBy("part").applyInArrow(lambda t: _gather(t, threshold), _LEFT))
    del sent, back
    if nb > 8:  # their shuffle files are worth the wait
        release(docs.sparkSession)
    members = left.select("set1", "set2", "doc_id").distinct()
    copies = members.groupBy("set1", "set2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    # the rows of one set have the same n-grams, so any of them will do; only the least of a part travels
    shown = left.groupBy("set1", "set2").agg(F.min_by(F.struct("n", "ranks"), "doc_id").alias("x"))
    one = checkpoint(shown.join(copies, ["set1", "set2"]).select("rep", F.col("set1").alias("s"), "set2", "x.n", "copies", "x.ranks"))
    posts = one.select("rep", "n", "ranks").mapInArrow(lambda it: _posts(it, threshold, nb), _POSTS)
    comp = checkpoint(components(posts.groupBy("bucket").applyInArrow(_linked, "a long, b long").distinct()))
    work = _units(one, comp, threshold).groupBy("component", "unit").applyInArrow(lambda t: _join(t, threshold), _WORK)
    several = members.join(one.where("copies > 1").select(F.col("s").alias("set1"), "set2", "rep", "copies"), ["set1", "set2"])
    every = several.select(F.col("doc_id").alias("id"), "rep", F.col("set1").alias("s"), "copies").unionByName(one.where("copies = 1").select(F.col("rep").alias("id"), "rep", "s", "copies"))
    return classes(every, work, alone=False).withColumnRenamed("id", "doc_id")


def superseded(docs: DataFrame, **how) -> DataFrame:
    """doc_id of all but the least id of each class."""
    return ngram_classes(docs, **how).where("doc_id <> class_id").select("doc_id")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs without the superseded ids, with all columns; see ngram_classes for the edge cases.  Rows that repeat the id that stays with
    another text of its class stay as well, and so do rows with a null id."""
    return drop_ids(docs, superseded(docs, **how))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(table(spark, sf_dir, "documents"))


SQL = {
    "op3_ngram_jaccard_join": f"""
WITH RECURSIVE tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10ffff}}]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, gram FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) < {N} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i:i + {N - 1}], ' ')) END) AS gram FROM tok WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE o.o >= ceil((x.n + y.n) * {THRESHOLD} / {1 + THRESHOLD} - 1e-9)),
reach AS (SELECT a AS id, a AS seen FROM link UNION SELECT id, b FROM reach JOIN link ON a = seen)
SELECT doc_id, class_id, n_links FROM (SELECT id AS doc_id, min(seen) AS class_id FROM reach GROUP BY id) JOIN (SELECT a AS doc_id, count(*) AS n_links FROM link GROUP BY a) USING (doc_id)
"""
}
QUERIES = {"op3_ngram_jaccard_join": op3_ngram_jaccard_join}
