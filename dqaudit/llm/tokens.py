"""Token counts of byte-level BPE by a two-tier table of pre-token lengths on the map side.

A pre-token's number of tokens depends on it alone.  Tier one is a compact hash table (64-bit hash to length) of the
pre-tokens that are frequent in the corpus, sent to every task; tier two is a table of fixed size in each worker process that takes what
its misses were encoded to, a later one over an earlier one.  Only misses of both are encoded, so no pre-token is ever shuffled: what
travels is one bounded list of frequent pre-tokens from each task, which choose the table's rows and change no result.
Splitting into pre-tokens follows the usual pattern ('s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^sLN]+|s+(?!S)|s+), done on arrays of code points.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .kernels import U64, buffers, mix, powers, slices

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Frequent pre-tokens of tier one; those that a task reports; places of a worker's tier two.
FREQUENT, REPORTED, WORKER = 1 << 16, 1 << 13, 1 << 21
OTHER, LETTER, NUMBER, SPACE, END = range(5)


@cache
def encoding(folder: str = TOKENIZERS, name: str = VOCABULARY):
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = LETTER
        elif k == "N":
            kinds[c] = NUMBER
    kinds[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return kinds, mix(np.arange(1, 0x110001, dtype=np.uint64)) | U64(1)


class Pieces:
    """Pre-tokens of some texts: ``start`` (characters of ``text``), ``hash``, ``doc``."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        kinds, values = _classes()
        self.text = buf.tobytes().decode("utf-8")
        cp = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        self.n, n = len(offs) - 1, len(cp)
        chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offs] if len(cp) != len(buf) else offs
        kind = kinds[cp]
        first = np.zeros(n + 1, bool)
        first[chars] = True
        nxt = np.empty(n, np.uint8)
        nxt[:-1] = kind[1:]
        nxt[first[1:]] = END
        head = first[:n].copy()
        head[1:] |= kind[1:] != kind[:-1]
        prev_blank = np.zeros(n, bool)
        prev_blank[1:] = cp[:-1] == 32
        prev_blank[first[:n]] = False
        space = kind == SPACE
        start = head & (space | ~prev_blank)
        start |= space & (nxt != SPACE) & (nxt != END)
        apostrophe = np.flatnonzero((cp == 39) & head & ~prev_blank & (nxt == LETTER))
        if len(apostrophe):
            a = cp[apostrophe + 1]
            two = np.minimum(apostrophe + 2, n - 1)
            b = np.where((apostrophe + 2 < n) & ~first[np.minimum(apostrophe + 2, n)], cp[two], 0)
            one = np.isin(a, [ord(x) for x in "stmd"])
            pair = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            start[apostrophe[one | pair] + 1] = False
            after = np.concatenate([apostrophe[one] + 2, apostrophe[pair] + 3])
            after = after[after < n]
            start[after] = True
        self.start = np.flatnonzero(start)
        self.end = np.append(self.start[1:], n)
        self.doc = np.searchsorted(chars, self.start, "right") - 1
        if not len(self.start):
            self.hash = np.zeros(0, np.uint64)
            return
        size = self.end - self.start
        within = np.arange(n) - np.repeat(self.start, size)
        self.hash = mix(np.add.reduceat(values[cp] * powers(int(size.max()) + 1)[within], self.start))

    def piece(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]]

    def __len__(self) -> int:
        return len(self.start)


def pieces(col: pa.Array) -> Iterator[tuple[int, Pieces]]:
    buf, offs = buffers(col)
    for lo, hi in slices(offs, 1 << 20):
        yield lo, Pieces(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])


class Lookup:
    """A table of fixed size from hashes to numbers; each hash has two places."""

    def __init__(self, places: int):
        self.bits = places.bit_length() - 1
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)

    def _at(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = U64((1 << self.bits) - 1)
        return (h & mask).astype(np.int64), ((h >> U64(32)) & mask).astype(np.int64)

    def get(self, h: np.ndarray) -> np.ndarray:
        """-1 where absent."""
        a, b = self._at(h)
        return np.where(self.keys[a] == h, self.values[a], np.where(self.keys[b] == h, self.values[b], -1))

    def put(self, h: np.ndarray, values: np.ndarray) -> None:
        a, b = self._at(h)
        at = np.where((self.keys[a] == 0) | (self.keys[b] != 0), a, b)
        self.keys[at] = h
        self.values[at] = values  # of several for one place numpy keeps the last, for both arrays alike


def _report(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The most frequent pre-tokens of a task, with counts."""
    count: dict[int, list] = {}
    for batch in batches:
        for _, p in pieces(batch.column(0)):
            h, first, n = np.unique(p.hash, return_index=True, return_counts=True)
            for i in np.argsort(-n, kind="stable")[: 2 * most].tolist():
                if n[i] == 1:
                    break
                if (held := count.get(int(h[i]))) is not None:
                    held[0] += int(n[i])
                elif p.end[first[i]] - p.start[first[i]] <= 64:
                    count[int(h[i])] = [int(n[i]), p.piece(int(first[i]))]
            if len(count) > 8 * most:
                count = dict(sorted(count.items(), key=lambda x: -x[1][0])[: 4 * most])
    top = sorted(count.items(), key=lambda x: (-x[1][0], x[0]))[:most]
    yield pa.record_batch([pa.array([np.int64(np.uint64(h)) for h, _ in top], pa.int64()), pa.array([c for _, (c, _) in top], pa.int64()), pa.array([x for _, (_, x) in top], pa.string())], names=["hash", "n", "piece"])


def frequent(docs: DataFrame, text_col: str = "text", most: int = FREQUENT, reported: int = REPORTED) -> list[tuple[int, str]]:
    """(hash, pre-token) of the ``most`` most frequent pre-tokens by the tasks' reports over all texts."""
    src = docs.select(docs[text_col].alias("__text")).where("__text IS NOT NULL")
    got = src.mapInArrow(lambda it: _report(it, reported), "hash long, n long, piece string").groupBy("hash").agg(F.sum("n").alias("n"), F.min("piece").alias("piece"))
    return [(r["hash"], r["piece"]) for r in got.orderBy(F.desc("n"), "hash").limit(most).collect()]


class Counter:
    """Tokens of pre-tokens: tier one as given, tier two per process."""

    def __init__(self, rows: list[tuple[int, int]], folder: str, name: str, worker: int = WORKER):
        self.first = Lookup(max(1 << 10, 1 << (2 * len(rows)).bit_length()))
        if rows:
            # the most frequent is put last and wins a place that two want
            h = np.array([h for h, _ in rows[::-1]], np.int64).view(np.uint64)
            self.first.put(h, np.array([n for _, n in rows[::-1]], np.int32))
        self.second = Lookup(worker)
        self.folder, self.name = folder, name

    def lengths(self, p: Pieces) -> np.ndarray:
        out = self.first.get(p.hash)
        miss = np.flatnonzero(out < 0)
        if len(miss):
            out[miss] = self.second.get(p.hash[miss])
            miss = miss[out[miss] < 0]
        if len(miss):
            h, at, back = np.unique(p.hash[miss], return_index=True, return_inverse=True)
            enc = encoding(self.folder, self.name)
            n = np.array([len(enc.encode_ordinary(p.piece(i))) for i in miss[at].tolist()], np.int32)
            self.second.put(h, n)
            out[miss] = n[back]
        return out


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_pieces, n_tokens of every row.

    A null or empty text has 0 of either; a very long one is counted whole; null ids and repeated rows are kept as they are; ids are cast to
    long (under ANSI another kind of id raises).  Pre-tokens of equal frequency at the table's end are taken by hash; that changes which tier
    counts them, never the count.  Other columns don't matter, whatever their names.  An empty table gives an empty table."""
    enc = encoding(folder, name)
    rows = [(h, len(enc.encode_ordinary(x))) for h, x in frequent(docs, text_col, most)]
    sent = docs.sparkSession.sparkContext.broadcast((np.array(rows, np.int64).reshape(-1, 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter([(int(a), int(b)) for a, b in sent.value], folder, name)
        for batch in batches:
            tokens, own = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for lo, p in pieces(batch.column(1)):
                tokens[lo : lo + p.n] = np.bincount(p.doc, weights=counter.lengths(p), minlength=p.n)
                own[lo : lo + p.n] = np.bincount(p.doc, minlength=p.n)
            yield pa.record_batch([batch.column(0), pa.array(own), pa.array(tokens)], names=["doc_id", "n_pieces", "n_tokens"])

    src = docs.select(docs[id_col].cast("long").alias("__id"), docs[text_col].alias("__text"))
    return src.mapInArrow(run, "doc_id long, n_pieces long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op5_token_counts": op5_token_counts}
