"""A packed exchange: 64-bit keys of many small items travel between Spark tasks as sorted binary columns.

Rows of hashes would cost Spark several times their bytes and a JVM object walk each.  Here a task packs
(48-bit hash, 16-bit number of the text in its part) into one sorted ``uint64`` array and cuts that by the
leading bits into one binary value per bucket.  A bucket's reducer sees all occurrences of its hashes and
answers each part with what it learnt.  Parts are numbered from the Spark partition, so that a task that is
run again after an executor's loss sends the same rows again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
IDX = U64(0xFFFF)
#: Texts of one part at most: their numbers have 16 bits.
PART_TEXTS = 0xFFFF
#: Items of one part after which it is sent, at least and at most.
PART_ITEMS, MOST_ITEMS = 2 << 20, 16 << 20
#: Buckets at most: a part of MOST_ITEMS then has about 1 KB for each, so rows don't become tiny with many parts and buckets.
MOST_BUCKETS = 1 << 17


def part_items(n_buckets: int) -> int:
    """Items after which a part is sent: 128 for each bucket, within bounds."""
    return max(PART_ITEMS, min(MOST_ITEMS, 128 * n_buckets))


def part_number(flush: int) -> int:
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 20) | flush


def pack(hashes: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    keys = np.sort((hashes & ~IDX) | idx.astype(np.uint64))
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def edges(keys: np.ndarray, n_buckets: int, low: int = 16) -> np.ndarray:
    """Where the buckets begin and end in sorted keys; bucket b holds the b-th of n_buckets equal ranges of hashes, which are the keys
    without their ``low`` last bits."""
    at = np.zeros(n_buckets, np.uint64)
    if n_buckets > 1:
        at = np.arange(n_buckets, dtype=np.uint64) * U64((1 << 64) // n_buckets + 1) >> U64(low) << U64(low)
    return np.append(np.searchsorted(keys, at), len(keys))


def cut(keys: np.ndarray, n_buckets: int, low: int = 16) -> Iterator[tuple[int, bytes]]:
    """(bucket, bytes) of the sorted keys."""
    e = edges(keys, n_buckets, low)
    for b in np.flatnonzero(e[:-1] < e[1:]).tolist():
        yield b, keys[e[b] : e[b + 1]].tobytes()


def repeated(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values that occur at least twice, sorted; their counts)."""
    s = np.sort(hashes)
    if not len(s):
        return s, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    count = np.diff(np.append(first, len(s)))
    keep = count > 1
    return s[first[keep]], count[keep]


def lookup(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Position of each x in sorted_values, -1 where absent."""
    if not len(sorted_values):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return np.where(sorted_values[at] == x, at, -1)
