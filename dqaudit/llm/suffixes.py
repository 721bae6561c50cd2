"""Repeated passages by a suffix array that is refined by bucket pointers, distributed.

Suffixes are those of the texts' token sequences.  Their order is taken only as deep as a passage's least length L,
and ties between different prefixes are ordered by hash, as a shared prefix is all that is asked for.

1. Initial buckets: suffixes of the same first q tokens.  A task packs (hash of the q-gram, position in its part) for all its suffixes into
   8-byte keys, dealt to ranges (see ``exchange``) and sorted; a reducer sorts one range, which is one stretch of the suffix array,
   numbers the buckets of two or more suffixes, and returns these bucket identifiers to the suffixes' parts.  A suffix that is
   alone in its bucket has its place and leaves.
2. Refinement, again and again: where buckets are h tokens deep, a bucket's suffixes are sorted by the bucket identifier of the suffix h tokens
   later (or L - h, if that is less), which is known in the part; a suffix of which the later one has left is alone and leaves too.
   Keys (bucket, later bucket) are sorted by range again, and the new identifiers, 2 h deep, serve the next round; q = 13 and L = 50
   take three rounds: 13, 26, 50.
3. Neighbouring suffixes that remain are one repeated passage.

Shuffled are 8 bytes for each token once, and in each later round 8 bytes and about 5 back for each token of a repeated passage.  A key's range comes
from 22 bits of its hash that the packed key doesn't hold, so 42 bits and those of the range tell keys apart: 59 at the most ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import exchange as X
from .common import buckets, table
from .kernels import U64, mix, token_slices

#: Tokens of a passage at least, and of the first buckets' prefixes; bits of a position in its part.
LEAST, Q, BITS = 50, 13, 22
_POS = U64((1 << BITS) - 1)
_ROUND = "bucket int, part long, keys binary, head binary"
_BACK = "part long, bucket int, pos binary, ids binary, head binary"
_OUT = "doc_id long, start int, n_tokens int"
_KINDS = {"bucket": pa.int32(), "part": pa.int64(), **dict.fromkeys(("keys", "pos", "ids", "head"), pa.binary())}


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, _KINDS[n]) for c, n in zip(cols, names, strict=True)], names=list(names))


def _cut(h: np.ndarray, pos: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """(range, packed keys) of hashes and positions: the hash's last bits choose the range, its others and the position make the key."""
    b = ((h & _POS) * U64(n_buckets) >> U64(BITS)).astype(np.uint16 if n_buckets <= 1 << 16 else np.uint32)
    order = np.argsort(b, kind="stable")
    keys, b = ((h & ~_POS) | pos.astype(np.uint64))[order], b[order]
    at = np.append(np.searchsorted(b, np.arange(n_buckets, dtype=b.dtype)), len(b))
    for k in np.flatnonzero(at[:-1] < at[1:]).tolist():
        yield k, np.sort(keys[at[k] : at[k + 1]]).tobytes()


def _three(x: np.ndarray) -> bytes:
    """Numbers under 2^24 in 3 bytes each."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _of_three(data: pa.Buffer) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel().astype(np.int64)


def _first(batches: Iterator[pa.RecordBatch], q: int, least: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Columns __id, __text.  head: (id, first position in the part, tokens, first token in the text) of each text; a text of more than
    2^22 tokens is cut into pieces that share least - 1 tokens."""
    held: list[tuple[np.ndarray, int]] = []
    head: list[tuple[int, int, int, int]] = []
    used = flush = 0
    most = (1 << BITS) - 1

    def out() -> pa.RecordBatch:
        nonlocal held, head, used, flush
        part = X.part_number(flush)
        h, at = np.concatenate([h for h, _ in held]), np.concatenate([np.arange(lo, lo + len(h)) for h, lo in held])
        rows = [(b, part, k, None) for b, k in _cut(h, at, n_buckets)]
        rows.append((part % n_buckets, part, None, np.array(head, np.int64).tobytes()))
        held, head, used, flush = [], [], 0, flush + 1
        return _batch(rows, ("bucket", "part", "keys", "head"))

    for batch in batches:
        batch = batch.filter(batch.column(0).is_valid())
        own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, tok in token_slices(batch.column(1)):
            size = np.diff(tok.of)
            g, _ = tok.grams(q)
            full = np.maximum(size - q + 1, 0)
            at = np.cumsum(full) - full
            for d in np.flatnonzero(size >= least).tolist():
                done = 0
                while done == 0 or size[d] - done >= least:
                    n = min(int(size[d]) - done, most)
                    if used + n > most:
                        yield out()
                    h = g[at[d] + done : at[d] + done + n - q + 1]
                    held.append((h, used))
                    head.append((int(own[lo + d]), used, n, done))
                    used += n
                    if done + n >= size[d]:
                        break
                    done += n - least + 1
    if head:
        yield out()


def _number(t: pa.Table, last: bool) -> pa.Table:
    """One range of keys: the buckets of two or more suffixes; their positions, and before the last round their identifiers (as differences), go
    back to the parts."""
    heads = t.filter(pc.is_valid(t["head"]))
    t = t.filter(pc.is_valid(t["keys"]))
    packed = [np.frombuffer(k.as_buffer(), np.uint64) for k in t["keys"]]
    values, _ = X.repeated(np.concatenate([k & ~_POS for k in packed]) if packed else np.zeros(0, np.uint64))
    rows = []
    for part, bucket, k in zip(t["part"].to_pylist(), t["bucket"].to_pylist(), packed, strict=True):
        at = X.lookup(values, k & ~_POS)
        own = at >= 0
        if own.any():
            rows.append((part, bucket, _three(k[own] & _POS), None if last else np.diff(at[own], prepend=0).astype(np.uint32).tobytes(), None))
    rows += [(p, b, None, None, h) for p, b, h in zip(heads["part"].to_pylist(), heads["bucket"].to_pylist(), heads["head"].to_pylist(), strict=True)]
    return pa.Table.from_batches([_batch(rows, ("part", "bucket", "pos", "ids", "head"))])


def _returned(t: pa.Table) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(positions in order, bucket identifiers, head) of a part."""
    head = t.filter(pc.is_valid(t["head"]))["head"][0].as_py()
    t = t.filter(pc.is_valid(t["pos"]))
    pos = [_of_three(p.as_buffer()) for p in t["pos"]]
    ids = [np.cumsum(np.frombuffer(i.as_buffer(), np.uint32).astype(np.uint64)) | (U64(b) << U64(32)) for i, b in zip(t["ids"], t["bucket"].to_pylist(), strict=True) if i.is_valid]
    pos = np.concatenate(pos) if pos else np.zeros(0, np.int64)
    order = np.argsort(pos, kind="stable")
    return pos[order], np.concatenate(ids)[order] if ids else np.zeros(0, np.uint64), head


def _refine(t: pa.Table, h: int, step: int, n_buckets: int) -> pa.Table:
    """One part, buckets h deep: keys h + step deep of the suffixes whose suffix step tokens later shares its bucket too."""
    pos, ids, head = _returned(t)
    texts = np.frombuffer(head, np.int64).reshape(-1, 4)
    later = X.lookup(pos, pos + step)
    d = np.searchsorted(texts[:, 1], pos, "right") - 1
    within = pos + h + step <= (texts[d, 1] + texts[d, 2]) if len(pos) else np.zeros(0, bool)
    i = np.flatnonzero((later >= 0) & within)
    part = t["part"][0].as_py()
    rows = [(b, part, k, None) for b, k in _cut(mix(mix(ids[i] + U64(1)) * U64(3) + ids[later[i]]), pos[i], n_buckets)]
    rows.append((part % n_buckets, part, None, head))
    return pa.Table.from_batches([_batch(rows, ("bucket", "part", "keys", "head"))])


def _spans(t: pa.Table, least: int) -> pa.Table:
    """One part: runs of neighbouring suffixes."""
    pos, _, head = _returned(t)
    texts = np.frombuffer(head, np.int64).reshape(-1, 4)
    if not len(pos):
        return pa.table({"doc_id": pa.array([], pa.int64()), "start": pa.array([], pa.int32()), "n_tokens": pa.array([], pa.int32())})
    d = np.searchsorted(texts[:, 1], pos, "right") - 1
    first = np.flatnonzero(np.concatenate([[True], (np.diff(pos) > 1) | (np.diff(d) > 0)]))
    last = np.append(first[1:], len(pos)) - 1
    d = d[first]
    start = pos[first] - texts[d, 1] + texts[d, 3]
    return pa.table({"doc_id": pa.array(texts[d, 0]), "start": pa.array(start.astype(np.int32)), "n_tokens": pa.array((pos[last] - pos[first] + least).astype(np.int32))})


def rounds(q: int, least: int) -> list[tuple[int, int]]:
    """(depth of the buckets, offset of the later suffix) of each refinement."""
    out, h = [], q
    while h < least:
        out.append((h, min(h, least - h)))
        h += out[-1][1]
    return out


def repeated_passages(docs: DataFrame, least: int = LEAST, q: int = Q, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, start (token number), n_tokens: the longest stretches of a text in which every ``least`` consecutive tokens also stand
    elsewhere, in another text or in the same.

    Rows with a null id are left out; ids are cast to long (under ANSI another kind of id raises); null, empty and shorter texts have none;
    rows that repeat have each other's text whole, each in a row of its own.  A passage counts whatever the number of its places.  A text of
    over 2^22 tokens is cut into pieces that overlap, so nothing is lost, but a passage over a cut is two rows.  Other columns don't matter,
    whatever their names.  An empty table gives an empty table.
    """
    q = min(q, least)
    src = docs.select(docs[id_col].cast("long").alias("__id"), docs[text_col].alias("__text"))
    nb = buckets(src, bucket_bytes)
    refine = lambda h, step: lambda t: _refine(t, h, step, nb)
    number = lambda last: lambda t: _number(t, last)
    sent, todo = src.mapInArrow(lambda it: _first(it, q, least, nb), _ROUND), rounds(q, least)
    back = sent.groupBy("bucket").applyInArrow(number(not todo), _BACK)
    for k, (h, step) in enumerate(todo):
        again = back.groupBy("part").applyInArrow(refine(h, step), _ROUND)
        back = again.groupBy("bucket").applyInArrow(number(k == len(todo) - 1), _BACK)
    return back.groupBy("part").applyInArrow(lambda t: _spans(t, least), _OUT)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


SQL = {
    "op9_suffix_array_dedup": """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10ffff}]+') AS w FROM documents),
g AS (SELECT doc_id, j, hash(array_to_string(w[j:j + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS j FROM w WHERE len(w) >= 50)),
r AS (SELECT doc_id, j, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS island FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1))
SELECT doc_id, (min(j) - 1)::INT AS start, (max(j) - min(j) + 50)::INT AS n_tokens FROM r GROUP BY doc_id, island
"""
}
QUERIES = {"op9_suffix_array_dedup": op9_suffix_array_dedup}
