"""License scans: patience alignment.

Words unique to both a text and a template are anchors; the longest increasing
subsequence of their places keeps those in common order, and each gap between
anchors is aligned the same way, down to gaps without anchors, where equal
words at the gap's two ends still count. Coverage is the share of the
template's words that align.

A text may hold a license more than once or deep inside other words, where its
words are no longer unique, so places are found first. The longest common
subsequence with the template, the most that any alignment can reach, is kept
as bits while words are read: from every start it gives the nearest end at
which the coverage is reached, and from that end the last start. The shortest
of these stretches is taken first, then the shortest of those to its left and
right, until none is left; however many other words stand between, a stretch
counts. A place then takes in further template words on both sides while the
gap before the next is no longer than the place, and is aligned; where repeated
words make patience miss a pair, the longest common subsequence is taken. Texts
that lack the template's words altogether leave after one set intersection.
Texts are scanned where they lie; nothing is shuffled. The templates are a
parameter of a fixed size.

Words are runs of letters and digits, without case. Defined results: a null or
empty text or template gives no match; repeated rows are reported each; an
empty table gives no rows; extra columns are ignored; templates that share a
place are all reported, best coverage first by `rank`.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

# Public license notices and grants.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT-notice": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SEPARATORS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
MATCH = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int32()), ("coverage", pa.float64()), ("rank", pa.int32())])


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:  # equal ends align whether unique or not
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if nb[w] == 1}
        pairs = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if na[w] == 1 and w in where]
        if not pairs:
            continue
        tops: list[int] = []
        at: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(pairs):
            p = bisect_left(tops, j)
            back.append(at[p - 1] if p else -1)
            if p == len(tops):
                tops.append(j)
                at.append(k)
            else:
                tops[p], at[p] = j, k
        chain, k = [], at[-1]
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        chain.reverse()
        out += chain
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:]) if x + 1 < y and u + 1 < v]
    return sorted(out)


def longest(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of a longest common subsequence."""
    rows = [[0] * (len(b) + 1)]
    for w in a:
        above, row = rows[-1], [0]
        for j, v in enumerate(b):
            row.append(above[j] + 1 if v == w else max(above[j + 1], row[j]))
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif rows[i - 1][j] >= rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def masks(template: list) -> dict:
    out: dict = {}
    for j, w in enumerate(template):
        out[w] = out.get(w, 0) | 1 << j
    return out


class Common:
    """The length of the longest common subsequence with a template of n words,
    as words are read one by one (Hyyro's bit-parallel recurrence)."""

    def __init__(self, mask: dict, n: int):
        self.mask, self.full, self.bits, self.n = mask, (1 << n) - 1, (1 << n) - 1, n

    def read(self, word) -> int:
        both = self.bits & self.mask[word]
        self.bits = ((self.bits + both) | (self.bits - both)) & self.full
        return self.n - self.bits.bit_count()


class Templates:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.words = {name: WORD.findall((text or "").encode().translate(SEPARATORS)) for name, text in sorted(templates.items())}
        self.words = {name: w for name, w in self.words.items() if w}
        self.bags = {name: Counter(w) for name, w in self.words.items()}
        self.masks = {name: (masks(w), masks(w[::-1])) for name, w in self.words.items()}
        self.all = frozenset(w for words in self.words.values() for w in words)
        self.coverage = coverage

    def stretches(self, words: list[bytes], places: list[int], name: str) -> list[tuple[int, int]]:
        """The stretches that reach the coverage and hold no shorter one that
        does, as first and last index in places."""
        n, (ahead, back) = len(self.words[name]), self.masks[name]
        need = max(1.0, self.coverage * n)
        out, first = [], 0
        while first < len(places):
            common = Common(ahead, n)
            end = next((k for k in range(first, len(places)) if common.read(words[places[k]]) >= need), None)
            if end is None:
                break
            common = Common(back, n)
            first = next(k for k in range(end, -1, -1) if common.read(words[places[k]]) >= need)
            out.append((first, end))
            first += 1
        return out

    def widened(self, words: list[bytes], places: list[int], name: str, at: tuple[int, int], lo: int, hi: int) -> tuple[int, int]:
        """The stretch with the template words next to it, inside lo..hi."""
        first, end = at
        for step, mask in ((1, self.masks[name][0]), (-1, self.masks[name][1])):
            common, best = Common(mask, len(self.words[name])), 0
            for k in range(first, end + 1) if step == 1 else range(end, first - 1, -1):
                best = common.read(words[places[k]])
            for k in range(end + 1, hi + 1) if step == 1 else range(first - 1, lo - 1, -1):
                edge = places[end] if step == 1 else places[first]
                if abs(places[k] - edge) - 1 > places[end] - places[first] + 1:
                    break
                if (now := common.read(words[places[k]])) > best:
                    best = now
                    first, end = (first, k) if step == 1 else (k, end)
        return first, end

    def aligned(self, words: list[bytes], name: str) -> list[list[tuple[int, int]]]:
        """The aligned pairs (place in words, place in the template) of every place."""
        bag, template = self.bags[name], self.words[name]
        places = [i for i, w in enumerate(words) if w in bag]
        taken: list[tuple[int, int]] = []
        for first, end in sorted(self.stretches(words, places, name), key=lambda x: (places[x[1]] - places[x[0]], x)):
            k = bisect_left(taken, (first, end))
            if (k == 0 or taken[k - 1][1] < first) and (k == len(taken) or end < taken[k][0]):
                taken.insert(k, (first, end))
        out, lo = [], 0
        for k, at in enumerate(taken):
            first, end = self.widened(words, places, name, at, lo, taken[k + 1][0] - 1 if k + 1 < len(taken) else len(places) - 1)
            lo = end + 1
            inside, common = [words[i] for i in places[first : end + 1]], Common(self.masks[name][0], len(template))
            most = max(map(common.read, inside))
            pairs = patience(inside, template)
            if len(pairs) < most:
                pairs = longest(inside, template)
            out.append([(places[first + i], j) for i, j in pairs])
        return out

    def scan(self, text: bytes) -> list[tuple[str, int, int, int, float]]:
        """license, start, end (bytes), matched words, coverage; in order of place."""
        folded = text.translate(SEPARATORS)
        words = folded.split()
        present = self.all.intersection(words)
        spans, out = None, []
        for name, template in self.words.items():
            if sum(n for w, n in self.bags[name].items() if w in present) < self.coverage * len(template):
                continue
            for pairs in self.aligned(words, name):
                spans = spans or [m.span() for m in WORD.finditer(folded)]
                out.append((name, spans[pairs[0][0]][0], spans[pairs[-1][0]][1], len(pairs), len(pairs) / len(template)))
        return sorted(out, key=lambda x: (x[1], -x[4], x[0]))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = 0.8) -> DataFrame:
    """doc_id, license, start, end, matched, coverage, rank of every place."""

    def run(batches):
        known = Templates(templates, coverage)
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                if text:
                    ranked = sorted(known.scan(text), key=lambda x: (-x[4], -x[3], x[1], x[0]))
                    out += [(i, *m, k + 1) for k, m in enumerate(ranked)]
            columns = list(zip(*out)) or [()] * len(MATCH)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, MATCH)], schema=MATCH)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, start long, end long, matched int, coverage double, rank int")
