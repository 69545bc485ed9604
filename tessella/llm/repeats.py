"""Suffix-array dedup of repeated byte strings, across all documents.

Every byte that is covered by a string of `length` bytes which also starts
somewhere else (in any document, the same one included) is removed; strings
are judged on the input, overlaps count and matches never cross documents.

Sorting all suffixes of 100 TB is out of reach, but any two equal strings also
agree on where their smallest k-gram hash is, so it is enough to sort suffixes
around those anchors (about one in 93 bytes):

1. A scan finds each text's anchors, with a hash of the `context` around each:
   all bytes that a string of `length` bytes holding the anchor can reach.
2. Anchors are dealt out by their k-gram and sorted by context. A context seen
   in two places makes all of it repeated, no bytes needed. An anchor with one
   place drops out. What is left are anchors with several contexts: the edges
   of passages that agree for a while. Only one place of each such context
   goes on. Groups are streamed, so their size is free.
3. Those contexts are cut from the texts, dealt out by anchor, and each shard
   sorts its suffixes by external induction (see `suffixes`): disk-backed
   queues carry suffix tuples and common-prefix values from the contexts' last
   bytes to their first. A string is repeated when its common prefix with a
   neighbour reaches `length`. Depth is bounded by the context, so one level of
   induction names everything; names of the level above are the k-grams.
4. Spans come back by text and are cut out of every document with that text.

Texts are told apart by a 64-bit hash and their length, contexts by two 64-bit
hashes; both are far beyond what chance can match. Copies of one text are
handled once.

Defined results: a null text is empty, has no strings and nothing removed;
repeated rows are copies of each other, so all of a text of at least `length`
bytes goes; null and repeated doc_id are fine; an empty table gives no rows;
further columns of docs are carried along, whatever their names; only columns
named kept and spans make way for the results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_table, quoted, settled, texts, utf8
from .suffixes import Rows, repeated_starts

K = 16
BASE = 0x9E3779B97F4A7C15
PIECE = 1 << 19
FAR = 1 << 22


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of any stretch of a buffer, from sums of byte codes times powers."""

    def __init__(self):
        self.code = np.random.default_rng(20_240_101).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.size = 0

    def load(self, data: np.ndarray) -> None:
        if len(data) >= self.size:
            self.size = max(2 * len(data), 1 << 20)
            self.up, self.down = _powers(self.size, BASE), _powers(self.size, pow(BASE, -1, 1 << 64))
        self.sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.code[data] * self.up[: len(data)], out=self.sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.down[start])

    def grams(self, n: int) -> np.ndarray:
        return mix((self.sum[K:] - self.sum[:-K]) * self.down[: n - K + 1])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(parts: list[np.ndarray], length: int, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """part, place in it, anchor, and start and end of the context of every
    anchor, each once."""
    data = np.concatenate(parts)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    if len(data) < length:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    hasher.load(data)
    gram = hasher.grams(len(data))
    # the leftmost of the least: upper bits of the hash, then the place
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    order = ((gram >> bits) << bits) | np.arange(len(gram), dtype=np.uint64)
    least = sliding_min(order, length - K + 1)
    whole = np.zeros(len(data) + 1, np.int64)  # places where a string fits into its part
    fits = sizes >= length
    np.add.at(whole, begins[fits], 1)
    np.add.at(whole, ends[fits] - length + 1, -1)
    chosen = least[np.cumsum(whole[: len(least)]) > 0]
    at = np.unique(chosen & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    part = np.searchsorted(ends, at, "right")
    return part, at - begins[part], gram[at].view(np.int64), np.maximum(begins[part], at - (length - K)), np.minimum(ends[part], at + length)


FOUND = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("text_key", pa.int64()), ("n_bytes", pa.int64()), ("place", pa.int64()), ("span", pa.int64())])


def find_anchors(batches, length: int):
    """Rows of FOUND; with span > 0 a stretch already known to be repeated: the
    third and later places of a context inside one text."""
    hasher = Hasher()

    def work(parts: list[np.ndarray], keys: list[tuple[int, int, int]]):
        part, place, anchor, start, end = anchors(parts, length, hasher)
        key = np.array(keys, np.int64).reshape(-1, 3)
        size = np.array([len(p) for p in parts])[part]
        # a context that an edge of a piece clips is whole in the neighbouring piece
        whole = ((place >= length - K) | (key[part, 2] == 0)) & ((place + length <= size) | (key[part, 2] + size == key[part, 1]))
        part, place, anchor, start, end = (x[whole] for x in (part, place, anchor, start, end))
        if not len(part):
            return
        context = hasher.of(start, end)
        begins = np.cumsum([0] + [len(p) for p in parts])[:-1]
        at = place + begins[part]
        context = mix(context ^ ((at - start).astype(np.uint64) << np.uint64(20)) ^ (end - at).astype(np.uint64)).view(np.int64)
        owner = np.searchsorted(np.unique(key[:, 0]), key[:, 0])  # pieces of one text count as that text
        order = np.lexsort((at, context, anchor, owner[part]))
        o, a, c = owner[part][order], anchor[order], context[order]
        same = np.zeros(len(order), bool)
        same[1:] = (o[1:] == o[:-1]) & (a[1:] == a[:-1]) & (c[1:] == c[:-1])
        third = np.zeros(len(order), bool)
        third[2:] = same[2:] & same[1:-1]
        spare = np.zeros(len(order), bool)
        spare[order] = third
        shift = key[part, 2]
        n = end - start
        yield np.stack([anchor, context, key[part, 0], key[part, 1], place + shift, np.zeros_like(n)])[:, ~spare]
        if spare.any():
            lo, hi, p = (start - begins[part] + shift)[spare], n[spare], part[spare]
            first = np.ones(len(lo), bool)
            first[1:] = (p[1:] != p[:-1]) | (lo[1:] > np.maximum.accumulate((lo + hi) + p * (1 << 40))[:-1] - p[1:] * (1 << 40))
            head = np.flatnonzero(first)
            top = np.maximum.reduceat(lo + hi, head)
            yield np.stack([anchor[spare][head], context[spare][head], key[p[head], 0], key[p[head], 1], lo[head], top - lo[head]])

    def emit(parts, keys):
        for rows in work(parts, keys):
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], schema=FOUND)

    parts, keys, held = [], [], 0
    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
            if not text or len(text) < length:
                continue
            data = np.frombuffer(text, np.uint8)
            for at in range(0, len(data), FAR):  # long texts in pieces that overlap by what a context reaches
                lo = max(0, at - 2 * length)
                parts.append(data[lo : at + FAR + 2 * length])
                keys.append((key, len(data), lo))
                held += len(parts[-1])
                if held >= PIECE:
                    yield from emit(parts, keys)
                    parts, keys, held = [], [], 0
    if parts:
        yield from emit(parts, keys)


PLACES = pa.schema([("text_key", pa.int64()), ("n_bytes", pa.int64()), ("anchor", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _judged(anchor, key, n, start, end):
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(anchor[0], pa.int64(), mask=anchor[1]), pa.array(start), pa.array(end)], schema=PLACES)


def judge_contexts(batches, length: int):
    """From FOUND, sorted by anchor, context and place: repeated stretches
    (anchor null) and places whose context has to be compared (start: the
    anchor's place)."""
    back = length - K
    waiting = None  # the first place of the last context of an anchor that has shown no other context
    tail = None  # last row, not judged yet: the next may repeat it
    tail_same = False
    last = None  # anchor of the row before the tail's context

    def close(rows: np.ndarray, following: np.ndarray | None):
        nonlocal waiting, tail_same, last
        a, c = rows[0], rows[1]
        n = len(a)
        nxt = following if following is not None else None
        same = np.zeros(n + 1, bool)
        same[0] = tail_same
        same[1:n] = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
        same[n] = nxt is not None and nxt[0] == a[-1] and nxt[1] == c[-1]
        full = same[:-1] | same[1:]
        tail_same = bool(same[n])
        if full.any():
            place, size = rows[4][full], rows[3][full]
            yield _judged((a[full], np.ones(full.sum(), bool)), rows[2][full], size, np.maximum(0, place - back), np.minimum(size, place + length))
        heads = rows[:, ~same[:-1]]
        if heads.shape[1]:
            if waiting is not None:
                heads = np.concatenate([waiting, heads], axis=1)
            started = last is not None and waiting is None and heads[0][0] == last
            ha = heads[0]
            alike = np.zeros(len(ha) + 1, bool)
            alike[0] = started
            alike[1:-1] = ha[1:] == ha[:-1]
            need = alike[:-1] | alike[1:]
            hold = not need[-1]
            if need.any():
                k = np.flatnonzero(need)
                yield _judged((ha[k], np.zeros(len(k), bool)), heads[2][k], heads[3][k], heads[4][k], heads[4][k])
            waiting = heads[:, -1:] if hold else None
            last = ha[-1]

    for b in batches:
        if not b.num_rows:
            continue
        rows = np.stack([b.column(i).to_numpy() for i in range(6)])
        spans = rows[5] > 0
        if spans.any():
            s = rows[:, spans]
            yield _judged((s[0], np.ones(s.shape[1], bool)), s[2], s[3], s[4], s[4] + s[5])
            rows = rows[:, ~spans]
        if tail is not None:
            rows = np.concatenate([tail, rows], axis=1)
        if not rows.shape[1]:
            continue
        fresh = np.ones(rows.shape[1], bool)  # copies of a text show a place again
        fresh[1:] = (rows[:5, 1:] != rows[:5, :-1]).any(axis=0)
        rows = rows[:, fresh]
        if rows.shape[1] > 1:
            yield from close(rows[:, :-1], rows[:, -1])
        tail = rows[:, -1:]
    if tail is not None:
        yield from close(tail, None)


CONTEXT = pa.schema([("anchor", pa.int64()), ("text_key", pa.int64()), ("n_bytes", pa.int64()), ("place", pa.int64()), ("context", pa.binary())])


def cut_contexts(batches, length: int):
    """The bytes around each place: text_key, n_bytes, text, places -> CONTEXT."""
    back = length - K
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        held = 0
        for key, n, text, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), b.column(3).to_pylist()):
            for p in places:
                at = p["place"]
                piece = text[max(0, at - back) : at + length]
                for column, value in zip(out, (p["anchor"], key, n, at, piece)):
                    column.append(value)
                held += len(piece)
            if held > 16 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, CONTEXT)], schema=CONTEXT)
                out, held = [[], [], [], [], []], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, CONTEXT)], schema=CONTEXT)


def sort_contexts(batches, length: int, memory: int):
    """One shard: CONTEXT -> repeated stretches (PLACES)."""
    back = length - K
    width = back + length
    rows = Rows(width, memory)
    meta: list[np.ndarray] = []
    for b in batches:
        if not b.num_rows:
            continue
        body = b.column(4)
        offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + b.num_rows + 1].astype(np.int64)
        data = np.frombuffer(body.buffers()[2], np.uint8)
        place, n = b.column(3).to_numpy(), b.column(2).to_numpy()
        begin = back - np.minimum(place, back)
        size = offsets[1:] - offsets[:-1]
        block = np.zeros((b.num_rows, width), np.uint8)
        column = np.arange(width)
        filled = (column >= begin[:, None]) & (column < (begin + size)[:, None])
        block[filled] = data[offsets[0] : offsets[-1]]
        rows.append(block)
        meta.append(np.stack([b.column(1).to_numpy(), n, place, begin, begin + size]))
    if not meta:
        return
    key, n, place, begin, end = np.concatenate(meta, axis=1)
    starts = repeated_starts(rows.done(), begin, end, length, back + 1, limit=memory)
    for at in range(0, len(key), 50_000):
        some = np.zeros((len(starts[at : at + 50_000]), back + 3), np.int8)
        some[:, 1:-1] = starts[at : at + 50_000]
        step = np.diff(some, axis=1)
        r, first = np.nonzero(step == 1)
        _, last = np.nonzero(step == -1)  # the run is first to last - 1
        r = r + at
        yield _judged((key[r], np.ones(len(r), bool)), key[r], n[r], place[r] - back + first, place[r] - back + last - 1 + length)


def cut_spans(batches, at: int, in_place: bool = False):
    """Add kept and spans (merged) to rows whose columns `at` on are text and
    found. in_place: only put what is left of the text in its column."""
    for b in batches:
        kept, merged = [], []
        for text, found, copies in zip(texts(b.column(at)), b.column(at + 1).to_pylist(), b.column(at + 2).to_pylist()):
            text = text or b""
            spans: list[list[int]] = []
            if copies:
                spans = [[0, len(text)]]
            else:
                for s in sorted((x["start"], x["end"]) for x in found or ()):
                    if spans and s[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], s[1])
                    else:
                        spans.append([*s])
            parts, done = [], 0
            for s, e in spans:
                parts.append(text[done:s])
                done = e
            parts.append(text[done:])
            kept.append(b"".join(parts))
            merged.append([{"start": s, "end": e} for s, e in spans])
        if in_place:
            body = b.column(at)
            whole = [k.decode("utf-8", "ignore") if ok else None for ok, k in zip(body.is_valid().to_pylist(), kept)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(at)), pa.array(whole, pa.string())], names=b.schema.names[: at + 1])
            continue
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        arrays = [b.column(i) for i in range(at + 1)] + [pa.array(kept, pa.binary()), pa.array(merged, span)]
        yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names[: at + 1], "kept", "spans"])


def _marked(docs: DataFrame, length: int, memory: int) -> DataFrame:
    """_row (the other columns of docs), text, the stretches found in the text
    and whether all of it goes."""
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(*map(quoted, others)) if others else F.struct(F.lit(0))
    keyed = docs.select(row.alias("_row"), "text", F.xxhash64("text").alias("_key"), F.length(utf8("text")).cast("long").alias("_n"))
    own = F.xxhash64(*([F.col("_row.doc_id")] if "doc_id" in others else []), F.col("_key"))
    marks = settled(lambda: _marks(keyed.filter(F.col("_n") >= length).withColumn("_own", own), length, memory))
    return keyed.join(marks, ["_key", "_n"], "left").select("_row", "text", F.when(~F.col("_all"), F.col("_found")).alias("_found"), F.coalesce("_all", F.lit(False)).alias("_all"))


def _marks(long: DataFrame, length: int, memory: int) -> DataFrame:
    """_key, _n (of a text), _found (the stretches to remove) and _all (the text
    has copies, so all of it goes)."""

    found = long.select("_key", "text").mapInArrow(lambda x: find_anchors(x, length), "anchor long, context long, text_key long, n_bytes long, place long, span long")
    dealt = found.repartition("anchor").sortWithinPartitions("anchor", "context", "text_key", "n_bytes", "place", "span")
    judged = cut_table(dealt.mapInArrow(lambda x: judge_contexts(x, length), "text_key long, n_bytes long, anchor long, start long, end long"))

    # one row for each text: the least of its documents' own hashes; a text said to hold many places stays one row
    classes = long.groupBy("_key", "_n").agg(F.count(F.lit(1)).alias("_copies"), F.min("_own").alias("_own"))
    wanted = judged.filter("anchor is not null").groupBy(F.col("text_key").alias("_key"), F.col("n_bytes").alias("_n")).agg(F.collect_set(F.struct("anchor", F.col("start").alias("place"))).alias("places"))
    wanted = wanted.join(classes.select("_key", "_n", "_own"), ["_key", "_n"])
    bodies = long.select("_key", "_n", "_own", "text").join(wanted, ["_key", "_n", "_own"]).select("_key", "_n", "text", "places")
    contexts = bodies.mapInArrow(lambda x: cut_contexts(x, length), "anchor long, text_key long, n_bytes long, place long, context binary")
    contexts = contexts.repartition("anchor")
    edges = contexts.mapInArrow(lambda x: sort_contexts(x, length, memory), "text_key long, n_bytes long, anchor long, start long, end long")

    spans = judged.filter("anchor is null").unionByName(edges).groupBy(F.col("text_key").alias("_key"), F.col("n_bytes").alias("_n")).agg(F.collect_set(F.struct("start", "end")).alias("_found"))
    marks = spans.join(classes.filter("_copies > 1").select("_key", "_n", F.lit(True).alias("_all")), ["_key", "_n"], "full_outer")
    return marks.select("_key", "_n", F.when(F.col("_all").isNull(), F.col("_found")).alias("_found"), F.coalesce("_all", F.lit(False)).alias("_all"))


def remove_repeats(docs: DataFrame, length: int = 200, memory: int = 64 << 20) -> DataFrame:
    """The columns of docs (text last), kept (the bytes left) and spans (the
    byte ranges removed)."""
    joined = _marked(docs.drop("kept", "spans"), length, memory)
    out = T.StructType([*joined.schema.fields[:2], T.StructField("kept", T.BinaryType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    done = joined.mapInArrow(lambda x: cut_spans(x, 1), out)
    return done.select(*(F.col("_row")[c].alias(c) for c in docs.columns if c not in ("text", "kept", "spans")), "text", "kept", "spans")


def without_repeats(docs: DataFrame, length: int = 200, memory: int = 64 << 20) -> DataFrame:
    """docs with what is left of their texts. A character that a cut leaves in
    part goes; a null text stays null; n_chars, if there is one, is counted
    anew."""
    joined = _marked(docs, length, memory)
    done = joined.mapInArrow(lambda x: cut_spans(x, 1, in_place=True), T.StructType(joined.schema.fields[:2]))

    def column(name):
        if name == "n_chars":
            return F.length("text").cast(docs.schema[name].dataType)
        return F.col("text") if name == "text" else F.col("_row")[name]

    return done.select(*(column(c).alias(c) for c in docs.columns))
