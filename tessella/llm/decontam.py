"""Benchmark decontamination: q-gram lemma filtering.

A text within k edits of a pattern of m characters shares at least
m + 1 - q - k q of the pattern's q-grams, on diagonals (place in the document
minus place in the pattern) no more than k apart. Every document is scanned
once: its q-grams are looked up among the patterns' (a bit table first, then
the sorted grams), hits are counted in overlapping diagonal bands of width 2k,
and only bands that reach the bound are verified by banded alignment of the
whole pattern. Patterns are the benchmark items, those above `window`
characters cut into half-overlapping windows; k is `share` of the pattern. For
items shorter than `least` bytes k is lowered until the bound is positive. At
k = 0 (under 2 Q bytes) an item counts where it stands exactly, between word
borders; items under Q bytes, which have no q-gram, are looked up as numbers
among the document's stretches of their length.

Characters are UTF-8 bytes after two foldings that are no edits: ASCII capitals
to small letters, white space to a space. Items are handled in blocks of at
most `block` bytes, each one pass over the documents, so what travels to a
task is bounded however large the benchmark is. Nothing is shuffled.

Defined results: a null, empty or blank text or item matches nothing; `shared`
is 0 for items under Q bytes; `edits` and `shared` of an item in several windows
are those of the window with most; repeated documents are reported each, a
repeated item once; an empty table on either side gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cached, keep_rows, texts, utf8

Q = 8
FOLD = bytes(32 if c in b"\t\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("shared", pa.int32())])
TABLE = 1 << 22
#: Bytes of words, after folding; others, and the ends of a text, are borders.
IN_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])


def grams(text: bytes) -> np.ndarray:
    """The q-gram at each place as a 64-bit number (a view, no copy)."""
    return np.ndarray(len(text) - Q + 1, "<u8", text, strides=(1,)) if len(text) >= Q else np.empty(0, np.uint64)


def slot(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)


class Patterns:
    """The q-gram index of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]], share: float, window: int, least: int):
        self.item, self.text = [], []
        short: dict[int, dict[int, list]] = {}
        for i, text in items:
            text = text.translate(FOLD).strip()
            if 0 < len(text) < Q:
                short.setdefault(len(text), {}).setdefault(int.from_bytes(text, "little"), []).append(i)
            elif text:
                cuts = [0] if len(text) <= window else [*range(0, len(text) - window, window // 2), len(text) - window]
                for at in cuts:
                    self.item.append(i)
                    self.text.append(text[at : at + window])
        self.short = [(n, np.array(sorted(of), np.uint64), of) for n, of in sorted(short.items())]
        self.length = np.array([len(t) for t in self.text], np.int64)
        self.edits = np.array([int(share * len(t)) for t in self.text], np.int64)
        self.edits = np.where(self.length < least, np.minimum(self.edits, (self.length - Q) // Q), self.edits)
        self.exact = (self.length < least) & (self.edits == 0)
        self.bound = np.maximum(1, self.length + 1 - Q - self.edits * Q)
        every = [grams(t) for t in self.text]
        gram = np.concatenate([*every, np.empty(0, np.uint64)])
        order = np.argsort(gram, kind="stable")
        self.gram = gram[order]
        self.owner = np.repeat(np.arange(len(every)), [len(g) for g in every])[order] if every else np.empty(0, np.int64)
        self.place = np.concatenate([np.arange(len(g)) for g in every])[order] if every else np.empty(0, np.int64)
        self.table = np.zeros(TABLE, bool)
        self.table[slot(self.gram)] = True

    def __bool__(self) -> bool:
        return bool(self.text or self.short)

    def brief(self, text: bytes):
        """(item, start, end) of each place of an item without q-grams."""
        if not self.short:
            return
        data = np.frombuffer(text + bytes(Q), np.uint8)
        every = np.ndarray(len(text), "<u8", data.tobytes(), strides=(1,))
        for n, known, of in self.short:
            value = every[: max(0, len(text) - n + 1)] & np.uint64((1 << 8 * n) - 1)
            for at in np.flatnonzero(known[np.minimum(np.searchsorted(known, value), len(known) - 1)] == value).tolist():
                if bordered(text, at, at + n):
                    for item in of[int(value[at])]:
                        yield item, at, at + n

    def hits(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """pattern, place in the pattern, place in the document of each shared q-gram."""
        g = grams(text)
        at = np.flatnonzero(self.table[slot(g)])
        # a band that reaches its bound has that many hits close together
        few, reach = int(self.bound.min()), int((self.length + 2 * self.edits).max())
        if len(at) >= few:
            near = at[few - 1 :] - at[: len(at) - few + 1] <= reach
            mark = np.zeros(len(at) + 1, np.int64)
            where = np.flatnonzero(near)
            np.add.at(mark, where, 1)
            np.add.at(mark, where + few, -1)
            at = at[np.cumsum(mark[:-1]) > 0]
        else:
            at = at[:0]
        found = g[at]
        lo, hi = np.searchsorted(self.gram, found, "left"), np.searchsorted(self.gram, found, "right")
        n = hi - lo
        index = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.owner[index], self.place[index], np.repeat(at, n)

    def regions(self, text: bytes):
        """(pattern, start, end, shared) of each stretch that meets the edit-budget bound."""
        owner, place, at = self.hits(text) if self.text else (self.length,) * 3
        if not len(owner):
            return
        width = 2 * np.maximum(1, self.edits)
        diagonal = at - place + (1 << 20)
        for shift in (0, 1):  # two overlapping sets of bands: any k + 1 neighbouring diagonals share one
            band = (diagonal + shift * (width[owner] // 2)) // width[owner]
            # one pattern gram counts once in a band
            code = (owner << 40) | band
            order = np.lexsort((place, code))
            code, gram = code[order], place[order]
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (gram[1:] != gram[:-1])
            bands, count = np.unique(code[new], return_counts=True)
            owners, bands = bands >> 40, bands & ((1 << 40) - 1)
            enough = count >= self.bound[owners]
            owners, bands, count = owners[enough], bands[enough], count[enough]
            for o, b, n in zip(owners, bands, count):
                low = int(b * width[o] - shift * (width[o] // 2)) - (1 << 20)
                start = max(0, low - int(self.edits[o]))
                end = min(len(text), low + int(width[o] + self.length[o] + self.edits[o]))
                if end > start:
                    yield int(o), start, end, int(n)


def bordered(text: bytes, start: int, end: int) -> bool:
    """Whether no word runs over either end of a stretch."""
    cut = lambda k: 0 < k < len(text) and IN_WORD[text[k - 1]] and IN_WORD[text[k]]
    return not cut(start) and not cut(end)


def exact_places(pattern: bytes, text: bytes, start: int, end: int):
    while 0 <= (start := text.find(pattern, start, end)):
        if bordered(text, start, start + len(pattern)):
            yield start
        start += 1


def align(pattern: bytes, text: bytes, most: int, lead: int) -> tuple[int, int, int] | None:
    """Banded alignment of the whole pattern with a stretch of the text:
    (edits, start, end) if at most `most` edits do. lead: the places that the
    start may move, so row i of the table covers columns i - most to i + lead + most."""
    if (exact := text.find(pattern)) >= 0:
        return 0, exact, exact + len(pattern)
    p, t = np.frombuffer(pattern, np.uint8), np.frombuffer(text, np.uint8)
    wide = lead + 2 * most + 1
    far = 1 << 20
    column = np.arange(wide) - most  # column of cell j in row i: i + column[j]
    padded = np.concatenate([np.full(most + 1, 256), t, np.full(len(p) + wide, 256)]).astype(np.int64)
    cost = np.where((column >= 0) & (column <= len(t)), 0, far)
    start = np.where(column >= 0, column, 0)
    step = np.arange(wide)
    for i in range(1, len(p) + 1):
        # cell j: diagonal from cell j, above from cell j + 1, left from cell j - 1
        same = padded[i + column + most] == p[i - 1]
        take, origin = cost + ~same, start
        above, above_from = np.append(cost[1:] + 1, far), np.append(start[1:], 0)
        better = above < take
        take, origin = np.where(better, above, take), np.where(better, above_from, origin)
        at = i + column
        take = np.where((at >= 0) & (at <= len(t)), take, far)
        run = np.minimum.accumulate((take - step) * wide + step)  # the best left neighbour, by cost then place
        by = run % wide
        cost, start = take[by] - by + step, origin[by]
        cost = np.where((at >= 0) & (at <= len(t)), cost, far)
    j = int(cost.argmin())
    return (int(cost[j]), int(start[j]), int(len(p) + column[j])) if cost[j] <= most else None


def matches(text: bytes, patterns: Patterns) -> list[tuple[int, int, int, int, int]]:
    """item, start, end, edits, shared: the best match of each item in each place."""
    folded = text.translate(FOLD)
    best: dict[tuple[int, int], tuple] = {}
    for o, start, end, shared in patterns.regions(folded):
        if patterns.exact[o]:
            for a in exact_places(patterns.text[o], folded, start, end):
                best[o, -1 - a] = (0, a, a + int(patterns.length[o]), shared)
            continue
        found = align(patterns.text[o], folded[start:end], int(patterns.edits[o]), int(2 * max(1, patterns.edits[o])) + int(patterns.edits[o]))
        if found:
            edits, a, z = found[0], start + found[1], start + found[2]
            if (o, a) not in best or edits < best[o, a][0]:
                best[o, a] = (edits, a, z, shared)
    # a place shows in several bands: of matches that share more than half, the one with the fewest edits
    taken: dict[int, list] = {}
    for (o, a), match in sorted(best.items(), key=lambda x: (x[0][0], x[1][0], x[1][1])):
        half = int(patterns.length[o]) / 2
        near = [m for m in taken.get(o, ()) if min(m[2], match[2]) - max(m[1], match[1]) > half] if not patterns.exact[o] else []
        if near:
            del best[o, a]
        else:
            taken.setdefault(o, []).append(match)
    out: list[tuple[int, int, int, int, int]] = []
    for (o, _), (edits, a, z, shared) in sorted(best.items(), key=lambda x: (patterns.item[x[0][0]], x[1][1])):
        item = patterns.item[o]
        if out and out[-1][0] == item and a < out[-1][2]:  # windows of one item, or one place found in two bands
            last = out[-1]
            out[-1] = (item, min(a, last[1]), max(z, last[2]), max(edits, last[3]) if a != last[1] else min(edits, last[3]), max(shared, last[4]))
        else:
            out.append((item, a, z, edits, shared))
    out += [(item, a, z, 0, 0) for item, a, z in patterns.brief(folded)]
    return out


def _blocks(benchmark: DataFrame, share: float, window: int, least: int, block: int):
    """A maker of Patterns for each block of items, read one after another."""
    items = benchmark.select("item_id", utf8("text").alias("text")).filter(F.length("text") > 0).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block))  # half full on average, as a hash deals unevenly
    for k in range(blocks):
        part = [(i, bytes(t)) for i, t in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toLocalIterator()]
        part.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if part:
            key = ("patterns", hash(tuple(part)), share, window, least)
            yield lambda part=part, key=key: cached(key, lambda: Patterns(part, share, window, least))


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.1, window: int = 400, least: int = 40, block: int = 4 << 20) -> DataFrame:
    """doc_id, item_id, start, end (bytes of the text), edits, shared (q-grams)
    of every place that holds an item."""
    out = []
    for make in _blocks(benchmark, share, window, least, block):

        def run(batches, make=make):
            patterns = make()
            for b in batches:
                found = [(i, *m) for i, text in zip(b.column(0).to_pylist(), texts(b.column(1))) if text for m in matches(text, patterns)] if patterns else []
                columns = list(zip(*found)) or [()] * len(FOUND)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND)], schema=FOUND)

        out.append(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, start long, end long, edits int, shared int"))
    if not out:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start long, end long, edits int, shared int")
    return reduce(DataFrame.unionByName, out)


def clean(docs: DataFrame, benchmark: DataFrame, share: float = 0.1, window: int = 400, least: int = 40, block: int = 4 << 20) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    for make in _blocks(benchmark, share, window, least, block):

        def judge(make=make):
            patterns = make()
            return lambda b: [not (text and patterns and matches(text, patterns)) for text in texts(b.column("text"))]

        docs = keep_rows(docs, judge)
    return docs
