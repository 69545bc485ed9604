"""N-gram Jaccard join with signature trees.

Documents are sets of word n-gram hashes (64 bits); two link when their
Jaccard similarity reaches a threshold t. The result is exact: the links'
connected components.

Documents with one set are handled as one. A set that has a partner shares one
of its |A| - ceil(t |A|) + 1 smallest hashes with it (prefix filter), so sets
meet only where they share such a token; tokens with one set end there. The sets
of a token are split where their sizes are too far apart for a link, and tokens
with the same sets count as one, so a family is not met again for each of its
tokens.

Every set goes to one cell, that of its most shared token, so a family of copies
meets in one place. A cell holds at most `cell` sets of neighbouring sizes; so
does a block of the sets that share a token across cells, and blocks meet in
pairs, so no task holds a whole group. In a cell or a pair of blocks signature
trees are built: leaves are token bitmaps, inner nodes the OR of theirs with the
range of set sizes. A dual traversal drops node pairs whose sizes or whose
largest possible overlap, popcount(A and B) plus the tokens that may share a
bit, cannot reach t. Nodes have 2048 bits; a large set's own bitmap has a bit or
more for each token, and leaves are compared on these.

Round 1 runs on bitmaps and marks the sets with a partner that no bound
excludes; only their texts are fetched. Round 2 checks cells on the sets
themselves, the most alike pairs first, and skips pairs already in one
component, so a family of n copies costs about n checks. Round 3 traverses the
blocks across cells again and checks, for each two components that a block
holds, its most alike pair, so what is left of a family grows together without
all its pairs. Round 4 does so once more and checks every pair of sets whose
components still differ. Pairs are checked on bitmaps of four bits a token
first, then on the sets.

Components of all rounds are merged by hooking to the least label and pointer
jumping, with a checkpoint each time. Links, components and fingerprints stay
distributed.

A set is known by its size and a 64-bit sum of its mixed hashes, a shingle by a
64-bit hash: exact but for collisions of those.

Defined results: a null, empty or wordless text has an empty set, links with
nothing and is its own component; repeated rows link with each other; a null
doc_id takes the component of its partners, null if it has none with an id; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, cut_table, quoted, settled, texts
from .repeats import Hasher, mix

FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BITS = 2048
CHUNK = 1 << 19


def shingle_sets(parts: list[bytes], words: int, hasher: Hasher) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = np.frombuffer(b"".join(p.translate(FOLD) + b" " for p in parts), np.uint8)
    hasher.load(data)
    letter = ~((data == 32) | ((data >= 9) & (data <= 13)))
    start = np.flatnonzero(letter & ~np.append(False, letter[:-1]))
    end = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    word = hasher.of(start, end)
    part = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), start, "right")
    count = np.bincount(part, minlength=len(parts))
    n = max(0, len(word) - words + 1)
    code = np.zeros(n, np.uint64)
    for k in range(words):
        code = mix(code * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n])
    inside = part[:n] == part[words - 1 :] if n else np.empty(0, bool)
    owner, code = part[:n][inside], code[inside]
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        first = np.cumsum(count) - count
        whole = []
        for p in short:
            value = np.full(1, 0x51ED270B + int(count[p]), np.uint64)
            for w in word[first[p] : first[p] + count[p]]:
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + w)
            whole.append(value[0])
        owner, code = np.append(owner, short), np.append(code, np.array(whole, np.uint64))
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    owner, code = owner[new], code[new]
    return np.split(code, np.cumsum(np.bincount(owner, minlength=len(parts)))[:-1])


def batches_of_sets(values, words: int, hasher: Hasher):
    """(index, set) of every text, computed for many texts at once."""
    part, held, first = [], 0, 0
    for i, text in enumerate(values):
        part.append(text or b"")
        held += len(part[-1])
        if held >= CHUNK:
            yield from enumerate(shingle_sets(part, words, hasher), first)
            part, held, first = [], 0, i + 1
    if part:
        yield from enumerate(shingle_sets(part, words, hasher), first)


def bitmap(tokens: np.ndarray, density: int = 1, least: int = BITS) -> bytes:
    """A bitmap of at least `density` bits a token, its size a power of two. The
    bits are the tokens' lowest, so the halves of a bitmap fold onto each other."""
    size = max(least, 1 << (density * len(tokens) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[tokens & np.uint64(size - 1)] = True
    return np.packbits(bits).tobytes()


def wide_bitmap(tokens: np.ndarray) -> bytes:
    return bitmap(tokens, density=4, least=512)


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) folded to this many 64-bit words."""
    return maps if maps.shape[-1] == words else np.bitwise_or.reduce(maps.reshape(len(maps), -1, words), axis=1)


class Maps:
    """The bitmaps of some sets, by size, and folded to the size of tree nodes."""

    def __init__(self, maps: list[bytes], tree: bool = True):
        length = np.array([len(m) for m in maps], np.int64) // 8
        self.words, self.place, self.of = length, np.zeros(len(maps), np.int64), {}
        self.folded = np.zeros((len(maps) if tree else 0, BITS // 64), np.uint64)
        for w in np.unique(length).tolist():
            at = np.flatnonzero(length == w)
            self.place[at] = np.arange(len(at))
            self.of[w] = np.frombuffer(b"".join(maps[k] for k in at), np.uint64).reshape(len(at), w)
            if tree:
                self.folded[at] = fold(self.of[w], BITS // 64)

    def take(self, at: np.ndarray) -> Maps:
        out = object.__new__(Maps)
        out.words, out.place, out.of, out.folded = self.words[at], self.place[at], self.of, self.folded[at]
        return out


def spare_overlap(a: Maps, i: np.ndarray, n: np.ndarray, b: Maps, j: np.ndarray, m: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """By how much the largest possible overlap of each pair of sets (of sizes n
    and m) exceeds what a link needs, on their own bitmaps."""
    out = np.zeros(len(i), np.int64)
    kinds = a.words[i] * (1 << 32) + b.words[j]
    for kind in np.unique(kinds).tolist():
        at = np.flatnonzero(kinds == kind)
        v, w = kind >> 32, kind & ((1 << 32) - 1)
        least, step = min(v, w), max(1, (1 << 21) // max(v, w))
        for k in (at[x : x + step] for x in range(0, len(at), step)):
            x, y = fold(a.of[v][a.place[i[k]]], least), fold(b.of[w][b.place[j[k]]], least)
            out[k] = np.minimum(n[k] - ones(x & ~y), m[k] - ones(y & ~x)) - _needed(n[k], m[k], t)
    return out


def ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


class SignatureTree:
    """levels[0] are the sets, each further level ORs FAN nodes of the one below."""

    FAN = 16

    def __init__(self, maps: Maps, sizes: np.ndarray):
        self.maps = maps
        self.levels = [(maps.folded, sizes, sizes, sizes - ones(maps.folded))]
        while len(self.levels[-1][0]) > self.FAN:
            m, lo, hi, spare = self.levels[-1]
            at = np.arange(0, len(m), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(spare, at)))


def _needed(x: np.ndarray, y: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """The least overlap of sets of these sizes: ceil(t / (1 + t) * (x + y))."""
    return -((-(x + y) * t[0]) // (t[0] + t[1]))


def candidates(a: SignatureTree, b: SignatureTree, t: tuple[int, int], within: bool):
    """Blocks of pairs of sets (and how far the bound exceeds the need) that no
    bound excludes. within: a is b, each pair once."""
    fan, block = SignatureTree.FAN, 1 << 15
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    i, j = (g.ravel() for g in np.meshgrid(np.arange(len(a.levels[la][0])), np.arange(len(b.levels[lb][0])), indexing="ij"))
    todo = [(la, lb, i, j)]
    while todo:
        la, lb, i, j = todo.pop()
        if within and la == lb:
            keep = i < j if la == 0 else i <= j
            i, j = i[keep], j[keep]
        if len(i) > block:
            todo += [(la, lb, i[k : k + block], j[k : k + block]) for k in range(0, len(i), block)]
            continue
        (ma, loa, hia, sa), (mb, lob, hib, sb) = a.levels[la], b.levels[lb]
        fits = (hia[i] * t[1] >= lob[j] * t[0]) & (hib[j] * t[1] >= loa[i] * t[0])
        i, j = i[fits], j[fits]
        if not len(i):
            continue
        x, y = ma[i], mb[j]
        if la == 0 and lb == 0:
            bound = np.minimum(loa[i] - ones(x & ~y), lob[j] - ones(y & ~x))
        else:
            bound = np.minimum(np.minimum(ones(x & y) + np.minimum(sa[i], sb[j]), hia[i]), hib[j])
        spare = bound - _needed(loa[i], lob[j], t)
        i, j, spare = i[spare >= 0], j[spare >= 0], spare[spare >= 0]
        if not len(i):
            continue
        if la == 0 and lb == 0:
            large = np.flatnonzero(np.minimum(a.maps.words[i], b.maps.words[j]) > BITS // 64)
            if len(large):
                spare[large] = spare_overlap(a.maps, i[large], loa[i[large]], b.maps, j[large], lob[j[large]], t)
                i, j, spare = i[spare >= 0], j[spare >= 0], spare[spare >= 0]
            if len(i):
                yield i, j, spare
        elif la >= lb:
            i, j = (i[:, None] * fan + np.arange(fan)).ravel(), np.repeat(j, fan)
            keep = i < len(a.levels[la - 1][0])
            todo.append((la - 1, lb, i[keep], j[keep]))
        else:
            i, j = np.repeat(i, fan), (j[:, None] * fan + np.arange(fan)).ravel()
            keep = j < len(b.levels[lb - 1][0])
            todo.append((la, lb - 1, i[keep], j[keep]))


def linked(x: np.ndarray, y: np.ndarray, t: tuple[int, int]) -> bool:
    """100 * intersection >= t * union, in whole numbers."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum()) if len(large) else 0
    return both * t[1] >= t[0] * (len(x) + len(y) - both)


def components(sets: list[np.ndarray], t: tuple[int, int]) -> np.ndarray:
    """The component (its first member) of each set; sets are in order of size."""
    parent = np.arange(len(sets))

    def root(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    tree = SignatureTree(Maps([bitmap(s) for s in sets]), np.array([len(s) for s in sets], np.int64))
    for i, j, spare in candidates(tree, tree, t, within=True):
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
        apart = parent[i] != parent[j]
        i, j, spare = i[apart], j[apart], spare[apart]
        order = np.argsort(-spare, kind="stable")
        for a, b in zip(i[order].tolist(), j[order].tolist()):
            ra, rb = root(a), root(b)
            if ra != rb and linked(sets[a], sets[b], t):
                parent[max(ra, rb)] = min(ra, rb)
    while (up := parent[parent]).tobytes() != parent.tobytes():
        parent = up
    return parent


def _groups(batches, columns: int):
    """Runs of rows that agree in the first `columns` columns (sorted input)."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in range(columns)]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for x, y in zip(edges, edges[1:]):
            here = tuple(c[x] for c in cols)
            if held and here != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = here
            held.append(b.slice(x, y - x))
    if held:
        yield key, pa.Table.from_batches(held)


DOCUMENT = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("bits", pa.binary()), ("prefix", pa.list_(pa.int64()))])
CELL = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("comp", pa.int64()), ("comp_n", pa.int64()), ("wide", pa.binary())])
HOME = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("token", pa.int64()), ("block", pa.int64()), ("active", pa.bool_())])


def describe(batches, words: int, t: tuple[int, int], most: int = 1 << 19):
    """Every document's set: its key, and its bitmap and prefix where a task
    meets the set first (or again after `most` others)."""
    hasher, seen = Hasher(), set()
    for b in batches:
        out: list[list] = [[], [], [], []]
        for _, s in batches_of_sets(texts(b.column(2)), words, hasher):
            n = len(s)
            out[0].append(n)
            out[1].append(int(mix(s).sum(dtype=np.uint64).view(np.int64)) if n else 0)
            new = n > 0 and (out[1][-1], n) not in seen
            if new:
                if len(seen) >= most:
                    seen.clear()
                seen.add((out[1][-1], n))
            out[2].append(s[: n + (-n * t[0] // t[1]) + 1].view(np.int64) if new else np.empty(0, np.int64))
            out[3].append(bitmap(s) if new else None)
        sizes = np.cumsum([0] + [len(p) for p in out[2]]).astype(np.int32)
        prefix = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([*out[2], np.empty(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[3], pa.binary()), prefix], schema=DOCUMENT)


def once_a_task(batches, most: int = 1 << 19):
    """own, text without the rows whose own a task has just met."""
    seen: set[int] = set()
    for b in batches:
        keep = []
        for own in b.column(0).to_pylist():
            keep.append(own not in seen)
            if keep[-1]:
                if len(seen) >= most:
                    seen.clear()
                seen.add(own)
        yield b.filter(pa.array(keep, pa.bool_()))


def shared_tokens(batches, t: tuple[int, int], most: int = 1 << 16):
    """token, n, key (sorted) -> the groups of sets that share a token and whose
    sizes are near enough, each under a hash of its members, with their number
    (`most` for that many or more: such groups are streamed under their token).
    Tokens with the same members thus give the same rows."""
    schema = pa.schema([("token", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("df", pa.int64())])
    held: np.ndarray | None = None  # rows of the last token, not written yet
    flushed = False  # whether rows of that token were written before

    def whole(rows):
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[2]), pa.array(rows[1]), pa.array(np.full(rows.shape[1], most))], schema=schema)

    def split(rows):
        token, n, key = rows
        # no pair reaches over a gap in the sizes
        new = np.append(True, (token[1:] != token[:-1]) | (n[:-1] * t[1] < n[1:] * t[0]))
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(token)))
        name = mix(np.add.reduceat(mix(key.view(np.uint64) + mix(n.view(np.uint64))), begin)).view(np.int64)
        keep = np.repeat(size > 1, size)
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (np.repeat(name, size), key, n, np.repeat(size, size))], schema=schema)

    for b in batches:
        rows = np.stack([b.column(i).to_numpy() for i in range(3)])
        if held is not None:
            rows = np.concatenate([held, rows], axis=1)
        if not rows.shape[1]:
            continue
        fresh = np.ones(rows.shape[1], bool)
        fresh[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
        rows = rows[:, fresh]
        begin = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
        done = begin[-1]
        if flushed and len(begin) > 1:
            yield whole(rows[:, : begin[1]])
            yield split(rows[:, begin[1] : done]) if done > begin[1] else whole(rows[:, :0])
            flushed = False
        elif done:
            yield split(rows[:, :done])
        held = rows[:, done:]
        if held.shape[1] > most:
            yield whole(held[:, :-1])
            held, flushed = held[:, -1:], True
    if held is not None and held.shape[1]:
        yield whole(held) if flushed else split(held)


def stir_cells(batches, t: tuple[int, int]):
    """token, block, n, key, bits (sorted) -> HOME: which sets have a partner in
    their cell that no bound excludes."""
    out = []
    for (token, block), group in _groups(batches, 2):
        key, n = group["key"].to_numpy(), group["n"].to_numpy()
        active = np.zeros(len(key), bool)
        if len(key) > 1:
            tree = SignatureTree(Maps(group["bits"].to_pylist()), n)
            for i, j, _ in candidates(tree, tree, t, within=True):
                active[i] = active[j] = True
        out.append((key, n, np.full(len(key), token), np.full(len(key), block), active))
        if len(out) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=HOME)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=HOME)


def stir_blocks(batches, t: tuple[int, int]):
    """As stir_cells, between sets of different cells: key, n, once for each
    block pair that shows it."""
    for group, found in _block_pairs(batches, t, ("home", "home_block")):
        active = np.zeros(group.num_rows, bool)
        for i, j, _ in found:
            active[i] = active[j] = True
        if active.any():
            yield pa.RecordBatch.from_arrays([pa.array(group[c].to_numpy()[active]) for c in ("key", "n")], names=["key", "n"])


def join_cells(batches, words: int, t: tuple[int, int]):
    """token, block, n, key, text (sorted) -> CELL."""
    hasher, out, held = Hasher(), [], 0
    for _, group in _groups(batches, 2):
        key, n = group["key"].to_numpy(), group["n"].to_numpy()
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (n[1:] != n[:-1])
        key, n = key[fresh], n[fresh]
        sets = [s for _, s in batches_of_sets([x for x, f in zip(texts(group["text"]), fresh) if f], words, hasher)]
        comp = components(sets, t)
        out.append((key, n, key[comp], n[comp], np.array([wide_bitmap(s) for s in sets], object)))
        held += sum(map(len, out[-1][4]))
        if len(out) > 5000 or held > 32 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out), CELL)], schema=CELL)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out), CELL)], schema=CELL)


def _block_pairs(batches, t: tuple[int, int], apart: tuple[str, str]):
    """token, first, second, side, n, key, bits and the columns of apart (sorted)
    -> each pair of blocks, with the pairs of its sets (and what they have to
    spare) that differ in those columns and that no bound excludes."""

    def pairs(group):
        side, n, maps = group["side"].to_numpy(), group["n"].to_numpy(), Maps(group["bits"].to_pylist())
        x, y = (group[c].to_numpy() for c in apart)
        if group["first"][0] == group["second"][0]:
            left = right = np.arange(len(n))
            tree = SignatureTree(maps, n)
            found = candidates(tree, tree, t, within=True)
        else:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            found = candidates(SignatureTree(maps.take(left), n[left]), SignatureTree(maps.take(right), n[right]), t, within=False)
        for i, j, spare in found:
            i, j = left[i], right[j]
            keep = (x[i] != x[j]) | (y[i] != y[j])
            if keep.any():
                yield i[keep], j[keep], spare[keep]

    for _, group in _groups(batches, 3):
        yield group, pairs(group)


PAIR = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("other_key", pa.int64()), ("other_n", pa.int64())])


def join_blocks(batches, t: tuple[int, int], every: bool):
    """The pairs of different components that no bound excludes; not every: of
    each two components in a block, only the pair with most to spare."""
    for group, found in _block_pairs(batches, t, ("comp", "comp_n")):
        key, n = group["key"].to_numpy(), group["n"].to_numpy()
        if not every:
            _, comp = np.unique(np.stack([group["comp"].to_numpy(), group["comp_n"].to_numpy()]), axis=1, return_inverse=True)
            best = np.empty((3, 0), np.int64)
            for pair in found:
                best = np.concatenate([best, np.stack(pair)], axis=1)
                x, y = comp[best[0]], comp[best[1]]
                kind = np.minimum(x, y) * len(comp) + np.maximum(x, y)
                order = np.lexsort((-best[2], kind))
                first = np.append(True, kind[order][1:] != kind[order][:-1])
                best = best[:, order[first]]
            found = [best] if best.shape[1] else []
        for i, j, _ in found:
            swap = (key[i] > key[j]) | ((key[i] == key[j]) & (n[i] > n[j]))
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            yield pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(n[i]), pa.array(key[j]), pa.array(n[j])], schema=PAIR)


def screen_pairs(batches, t: tuple[int, int]):
    """key, n, other_key, other_n, wide, other_wide -> the pairs that their wide
    bitmaps do not exclude."""
    for b in batches:
        n, m = b.column(1).to_numpy(), b.column(3).to_numpy()
        x, y, at = Maps(b.column(4).to_pylist(), tree=False), Maps(b.column(5).to_pylist(), tree=False), np.arange(b.num_rows)
        keep = pa.array(spare_overlap(x, at, n, y, at, m, t) >= 0)
        yield pa.RecordBatch.from_arrays([b.column(i).filter(keep) for i in range(4)], schema=PAIR)


def check_pairs(batches, words: int, t: tuple[int, int]):
    """key, n, other_key, other_n, text, other_text -> the linked pairs."""
    hasher = Hasher()
    for b in batches:
        x = [s for _, s in batches_of_sets(texts(b.column(4)), words, hasher)]
        y = [s for _, s in batches_of_sets(texts(b.column(5)), words, hasher)]
        keep = pa.array([linked(p, q, t) for p, q in zip(x, y)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(i).filter(keep) for i in range(4)], schema=PAIR)


def merge_components(links: DataFrame) -> DataFrame:
    """a, b -> a, label: the least node of the component of each node of a
    graph. Each round hooks every label to the least label next to it, then
    jumps pointers to their ends; labels left at least halve."""
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = edges.select("a").distinct().select("a", F.col("a").alias("label"))
    live = edges
    while not live.isEmpty():
        hook = live.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a"), F.least("a", "b").alias("up"))
        while True:  # pointer jumping
            hook = cut(hook)
            above = hook.select(F.col("a").alias("up"), F.col("up").alias("top"))
            jumped = hook.join(above, "up").select("a", "up", "top")
            if jumped.filter("top <> up").isEmpty():
                break
            hook = jumped.select("a", F.col("top").alias("up"))
        labels = cut(labels.join(hook.select(F.col("a").alias("label"), "up"), "label", "left").select("a", F.coalesce("up", "label").alias("label")))
        step = hook.select("a", "up")
        live = cut(live.join(step, "a").select(F.col("up").alias("a"), "b").join(step.select(F.col("a").alias("b"), F.col("up").alias("z")), "b").select("a", F.col("z").alias("b")).filter("a <> b").distinct())
    return labels


def _sized(rows: DataFrame, cell: int) -> DataFrame:
    """Add block (sets of a token in order of size, about `cell` to a block) and
    last (the token's last block). Blocks follow from the numbers of sets of each
    size, so no token's sets have to meet for it; df bounds a token's sets."""
    sizes = rows.filter(F.col("df") > cell).groupBy("token", "n").agg(F.count(F.lit(1)).alias("_c"))
    of = Window.partitionBy("token")
    before = F.coalesce(F.sum("_c").over(of.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("token", "n", F.floor(before / cell).alias("_at"), F.ceil(F.col("_c") / cell).alias("_parts")).withColumn("last", F.max(F.col("_at") + F.col("_parts") - 1).over(of))
    block = F.col("_at") + F.pmod(F.xxhash64("key"), F.col("_parts"))
    return rows.join(sizes, ["token", "n"], "left").withColumn("block", F.coalesce(block, F.lit(0)).cast("long")).withColumn("last", F.coalesce("last", F.lit(0))).drop("_at", "_parts")


def _blocks(placed: DataFrame, apart: list[str], t: tuple[int, int], cell: int) -> DataFrame:
    """The rows of tokens that different values of `apart` share, in blocks of
    about `cell` rows in order of size, dealt to each pair of blocks whose sizes
    are near enough: token, first, second, side and the columns of placed."""
    named = placed.withColumn("_apart", F.xxhash64(*apart))
    mixed = named.groupBy("token").agg(F.min("_apart").alias("lo"), F.max("_apart").alias("hi")).filter("lo <> hi").select("token")
    rows = cut_table(_sized(placed.join(mixed, "token"), cell).drop("df"))
    first = rows.filter("last = 0").select("*", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("second"), F.lit(0).alias("side"))
    many = rows.filter("last > 0")
    # a block meets itself and those after it whose least size is in reach; few tokens have a second block
    span = many.groupBy("token", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    after = span.select("token", F.col("block").alias("second"), F.col("lo").alias("lo2"))
    near = span.select("token", F.col("block").alias("first"), "hi").join(after, "token").filter((F.col("first") <= F.col("second")) & (F.col("hi") * t[1] >= F.col("lo2") * t[0])).select("token", "first", "second")
    use = near.select("*", F.lit(0).alias("side"), F.col("first").alias("block")).unionByName(near.filter("first < second").select("*", F.lit(1).alias("side"), F.col("second").alias("block")))
    return first.unionByName(many.join(use, ["token", "block"])).drop("block", "last")


def _dealt(rows: DataFrame, bits: DataFrame) -> DataFrame:
    head = ["token", "first", "second", "side", "n", "key"]
    rows = rows.join(bits, ["key", "n"]).select(*head, *(c for c in rows.columns if c not in head), "bits")
    return rows.repartition("token", "first", "second").sortWithinPartitions("token", "first", "second", "side", "n", "key")


def _links(shared: DataFrame, comp: DataFrame, bits: DataFrame, body: DataFrame, wide: DataFrame, words: int, t: tuple[int, int], cell: int, every: bool) -> DataFrame:
    """a, b: links between components. comp: key, n, comp, comp_n. Joins with
    texts and bitmaps are merge joins at every size, as what they fetch grows
    with the corpus."""
    pair = "key long, n long, other_key long, other_n long"
    across = _blocks(shared.join(comp, ["key", "n"]), ["comp", "comp_n"], t, cell)
    pairs = cut_table(_dealt(across, bits).mapInArrow(lambda x: join_blocks(x, t, every), pair).distinct())

    def both(rows, columns, value):
        other = columns.select(F.col("key").alias("other_key"), F.col("n").alias("other_n"), F.col(value).alias(f"other_{value}"))
        return rows.join(columns.select("key", "n", value).hint("merge"), ["key", "n"]).join(other.hint("merge"), ["other_key", "other_n"]).select("key", "n", "other_key", "other_n", value, f"other_{value}")

    pairs = cut_table(both(pairs, wide, "wide").mapInArrow(lambda x: screen_pairs(x, t), pair))
    links = cut_table(both(pairs, body, "text").mapInArrow(lambda x: check_pairs(x, words, t), pair))
    mine = comp.select("key", "n", F.struct("comp", "comp_n").alias("a"))
    other = mine.select(F.col("key").alias("other_key"), F.col("n").alias("other_n"), F.col("a").alias("b"))
    return links.join(mine, ["key", "n"]).join(other, ["other_key", "other_n"]).select("a", "b")


def join_components(docs: DataFrame, words: int = 4, threshold: tuple[int, int] = (85, 100), cell: int = 4096) -> DataFrame:
    """doc_id, n_shingles, component_id and set_key of every document; own: a
    hash of the document's id and text."""
    return settled(lambda: _components(docs, words, threshold, cell))


def _components(docs: DataFrame, words: int, t: tuple[int, int], cell: int) -> DataFrame:
    pair = "key long, n long"
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("own"), "text")
    described = cut_table(rows.mapInArrow(lambda x: describe(x, words, t), "doc_id long, own long, n long, key long, bits binary, prefix array<long>"))
    full = described.filter("n > 0")
    sets = full.groupBy("key", "n").agg(F.min("doc_id").alias("least"), F.min("own").alias("own"))
    token = full.select(F.explode("prefix").alias("token"), "n", "key")
    groups = token.repartition("token").sortWithinPartitions("token", "n", "key").mapInArrow(lambda x: shared_tokens(x, t), "token long, key long, n long, df long")
    shared = cut_table(groups.distinct())
    bits = cut_table(full.filter("bits is not null").join(shared.select("key", "n").distinct(), ["key", "n"], "left_semi").groupBy("key", "n").agg(F.any_value("bits").alias("bits")))

    home = shared.groupBy("key", "n").agg(F.max(F.struct("df", "token")).alias("x")).select("key", "n", F.col("x.token").alias("token"), F.col("x.df").alias("df"))
    home = _sized(home, cell).join(bits, ["key", "n"]).select("token", "block", "n", "key", "bits").repartition("token", "block").sortWithinPartitions("token", "block", "n", "key")
    home = cut_table(home.mapInArrow(lambda x: stir_cells(x, t), f"{pair}, token long, block long, active boolean"))
    place = home.select("key", "n", F.col("token").alias("home"), F.col("block").alias("home_block"))
    across = _blocks(shared.join(place, ["key", "n"]), ["home", "home_block"], t, cell)
    crossing = _dealt(across, bits).mapInArrow(lambda x: stir_blocks(x, t), pair)
    active = cut_table(home.filter("active").select("key", "n").unionByName(crossing).distinct().join(home.drop("active"), ["key", "n"]).join(sets.select("key", "n", "own"), ["key", "n"]))

    once = rows.select("own", "text").mapInArrow(once_a_task, "own long, text string")
    body = cut_table(once.join(active.hint("merge"), "own").dropDuplicates(["own"]).select("token", "block", "n", "key", "text"))
    dealt = body.repartition("token", "block").sortWithinPartitions("token", "block", "n", "key")
    cells = cut_table(dealt.mapInArrow(lambda x: join_cells(x, words, t), f"{pair}, comp long, comp_n long, wide binary"))

    # only what has a partner by the bounds is left: rounds 3 and 4
    text, wide = body.select("key", "n", "text"), cells.select("key", "n", "wide")
    comp = cells.select("key", "n", "comp", "comp_n")
    for every in (False, True):
        labels = merge_components(_links(shared, comp, bits, text, wide, words, t, cell, every))
        old = F.struct("comp", "comp_n")
        new = comp.withColumn("a", old).join(labels, "a", "left").withColumn("a", F.coalesce("label", old))
        comp = cut_table(new.select("key", "n", F.col("a.comp").alias("comp"), F.col("a.comp_n").alias("comp_n")))

    label = comp.join(sets.select("key", "n", "least"), ["key", "n"])
    least = label.join(label.groupBy("comp", "comp_n").agg(F.min("least").alias("component_id")), ["comp", "comp_n"]).select("key", "n", "component_id")
    final = sets.select("key", "n", "least").join(least, ["key", "n"], "left").select("key", "n", F.coalesce("component_id", "least").alias("component_id"))
    out = described.select("doc_id", "own", "n", "key").join(final, ["key", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("key").alias("set_key"), "own")


def one_of_each(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100), cell: int = 4096) -> DataFrame:
    """One document of each component, the one with the least id (a null id
    comes last), with all its columns; of rows with that id and text, the one
    with the least hash of all columns. Documents without words stay, as they
    link with nothing."""
    found = join_components(docs, words, threshold, cell)
    some = found.filter("n_shingles > 0")
    first = some.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "own")).alias("x")).select(F.col("x.own").alias("_own"))
    stay = first.withColumn("_once", F.lit(True)).unionByName(found.filter("n_shingles = 0").select(F.col("own").alias("_own")).distinct().withColumn("_once", F.lit(False)))
    whole = F.xxhash64(F.to_json(F.struct(*(quoted(c) for c in docs.columns if c != "text"))))
    marked = docs.withColumn("_own", F.xxhash64("doc_id", "text")).withColumn("_whole", whole)
    rows = marked.groupBy("_own").agg(F.count(F.lit(1)).alias("_rows"), F.min("_whole").alias("_least"))
    kept = marked.join(stay.join(rows, "_own").hint("merge"), "_own")
    single = kept.filter("_rows = 1 or not _once").select(*map(quoted, docs.columns))
    # rows that are alike in everything meet only once a task has made one of its own
    again = kept.filter("_rows > 1 and _once and _whole = _least").dropDuplicates(["_own"]).select(*map(quoted, docs.columns))
    return single.unionByName(again)
