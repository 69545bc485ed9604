"""External induced sorting of suffixes, with common-prefix values.

The queue holds suffix tuples (row, common prefix with the tuple before) in
suffix order. One round of induction moves every suffix one byte to the left:
tuples are drained in order, each is pushed into the bucket of the byte before
it, and buckets are drained in byte order, so the pushed suffixes come out
sorted without comparing strings. The common prefix of two neighbours in a
bucket is one more than the least value drained between them. Rounds run from
the last column of the rows to the first; what one round has sorted, the next
takes over, down to the suffix that starts a row.

Buckets and rows live in memory up to a limit and in unlinked temporary files
beyond it, so a shard may be far larger than memory.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Key of a place outside a row's text; it equals nothing, not even itself.
OUTSIDE = 256


class Rows:
    """Fixed-width rows of bytes that are appended, then read by index."""

    def __init__(self, width: int, limit: int):
        self.width, self.limit, self.parts, self.size, self.file, self.all = width, limit, [], 0, None, None

    def append(self, rows: np.ndarray) -> None:
        self.parts.append(rows)
        self.size += len(rows)
        if sum(map(len, self.parts)) * self.width > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for p in self.parts:
            self.file.write(np.ascontiguousarray(p).tobytes())
        self.parts = []

    def done(self) -> np.ndarray:
        if self.all is None:
            if self.file:
                self._spill()
                self.file.flush()
                self.all = np.memmap(self.file, np.uint8, "r", shape=(self.size, self.width))
            else:
                self.all = np.concatenate([*self.parts, np.empty((0, self.width), np.uint8)])
            self.parts = []
        return self.all


class TupleQueue:
    """A priority queue of (bucket, arrival) with one bucket for each byte."""

    KIND = np.dtype([("row", "<i8"), ("common", "<i4")])

    def __init__(self, limit: int):
        self.limit, self.held, self.buckets, self.file = limit, 0, [[] for _ in range(OUTSIDE + 1)], None

    def push(self, bucket: int, tuples: np.ndarray) -> None:
        self.buckets[bucket].append(tuples)
        self.held += tuples.nbytes
        if self.held > self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            for b in self.buckets:
                for k, t in enumerate(b):
                    if isinstance(t, np.ndarray):
                        at = self.file.seek(0, 2)
                        self.file.write(np.ascontiguousarray(t).tobytes())
                        b[k] = (at, len(t))
            self.held = 0

    def drain(self, block: int) -> Iterator[np.ndarray]:
        ready, n = [], 0
        for b in self.buckets:
            for t in b:
                if isinstance(t, tuple):
                    self.file.seek(t[0])
                    t = np.frombuffer(self.file.read(t[1] * self.KIND.itemsize), self.KIND)
                ready.append(t)
                n += len(t)
                if n >= block:
                    yield np.concatenate(ready)
                    ready, n = [], 0
            b.clear()
        if n:
            yield np.concatenate(ready)


def induce(queue: TupleQueue, keys_of, limit: int, block: int) -> TupleQueue:
    """One round: keys_of(rows) gives the byte before each suffix."""
    out = TupleQueue(limit)
    low = np.full(OUTSIDE + 1, -1, np.int64)  # least value since the bucket's last tuple; -1: no tuple yet
    for tuples in queue.drain(block):
        common, key = tuples["common"].astype(np.int64), keys_of(tuples["row"])
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.zeros(len(order), np.int64)
        same = np.flatnonzero(sorted_key[1:] == sorted_key[:-1]) + 1
        if len(same):
            ends = np.empty(2 * len(same), np.int64)
            ends[0::2], ends[1::2] = order[same - 1] + 1, order[same] + 1
            padded = np.append(common, 0)
            new[same] = np.minimum.reduceat(padded, ends)[::2] + 1
        first = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1]))
        last = np.append(first[1:], len(order)) - 1
        kinds = sorted_key[first]
        so_far = np.minimum.accumulate(common)
        seen = low[kinds] >= 0
        new[first] = np.where(seen, np.minimum(low[kinds], so_far[order[first]]) + 1, 0)
        new[sorted_key == OUTSIDE] = 0
        after = np.append(np.minimum.accumulate(common[::-1])[::-1], np.iinfo(np.int32).max)
        low = np.where(low >= 0, np.minimum(low, so_far[-1]), low)
        low[kinds] = after[order[last] + 1]
        sorted_tuples = np.empty(len(order), TupleQueue.KIND)
        sorted_tuples["row"], sorted_tuples["common"] = tuples["row"][order], new
        for k, a, z in zip(kinds.tolist(), first.tolist(), last.tolist()):
            out.push(k, sorted_tuples[a : z + 1])
    return out


def repeated_starts(rows: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int, columns: int, limit: int = 256 << 20, block: int = 1 << 20) -> np.ndarray:
    """For each row and each of its first `columns` columns: does the string of
    `length` bytes that starts there also start at that column of another row?
    A row's text fills the columns begin to end."""
    n, width = rows.shape
    out = np.zeros((n, columns), bool) if n * columns <= limit else np.memmap(tempfile.TemporaryFile(), bool, "w+", shape=(n, columns))
    queue = TupleQueue(limit)
    for at in range(0, n, block):
        some = np.zeros(min(block, n - at), TupleQueue.KIND)
        some["row"] = np.arange(at, at + len(some))
        queue.push(0, some)
    by_column = np.ascontiguousarray(rows.T) if n * width <= limit else None

    for c in range(width - 1, -1, -1):

        def keys_of(row):
            key = (by_column[c][row] if by_column is not None else rows[row, c]).astype(np.uint16)
            key[(c < begin[row]) | (c >= end[row])] = OUTSIDE
            return key

        queue = induce(queue, keys_of, limit, block)
        if c < columns:
            kept, before = TupleQueue(limit), None
            for tuples in queue.drain(block):
                hit = np.flatnonzero(tuples["common"] >= length)
                out[tuples["row"][hit], c] = True
                out[tuples["row"][hit[hit > 0] - 1], c] = True
                if len(hit) and hit[0] == 0 and before is not None:
                    out[before, c] = True
                before = tuples["row"][-1]
                kept.push(0, tuples)
            queue = kept
    return out
