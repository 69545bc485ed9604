"""Best-fit packing by sums of squares.

A document's ids, closed by id 0, fill sequences of `capacity` tokens. Only
longer documents are cut, from the end, so that the first piece is the short
one. Let N(g) be the number of open sequences with g free tokens. A piece of
length s goes where the sum of N(g)^2 becomes least: into a sequence with gap
h >= s (N(h) falls, N(h - s) rises) or into a new one. That keeps many
different gaps open, so later pieces find an exact fit; a full sequence (gap 0)
closes and leaves the sum. Pieces come in falling order of length, and a new
sequence is opened only where no gap fits; if that misses the lower bound (all
tokens over `capacity`), the order of a hash with new sequences at will is tried
too, and the fewer sequences win.

Tokenizing runs in the scan and emits 40 bytes for each piece; only these are
kept (in the shared checkpoint) and dealt out by a hash of the piece and its
place there, about `group` pieces to a task, so that repeated rows spread as
well. Each group is packed on its own, at a cost of about one open sequence
each.

Defined results: a null or empty text is one piece of length 1; repeated rows
are packed each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokens import default_vocabulary, encoder

PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PLACED = PIECE.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))


def pieces(docs: DataFrame, capacity: int = 2048, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        encode = encoder(vocabulary)
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(0)).astype("<u4")
                at = 0
                for k, end in enumerate(range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)):
                    out.append((i, k, at, end - at, zlib.crc32(ids[at:end].tobytes())))
                    at = end
            columns = list(zip(*out)) or [()] * len(PIECE)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECE)], schema=PIECE)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int, sparing: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length, in the order given. sparing: a new
    sequence only where no gap fits."""
    never = np.iinfo(np.int64).max
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened = 0
    for k, s in enumerate(lengths.tolist()):
        # the change of the sum is 2 * (N(h - s) - N(h)) + 2 for an open gap h > s, 1 - 2 * N(s) for an exact
        # fit, 2 * N(capacity - s) + 1 for a new sequence; among equals the tightest gap wins
        best, at = (2 * count[capacity - s] + 1, -1) if s < capacity else (0, -1)
        if sparing:
            best = never - 1
        if count[s] and 1 - 2 * count[s] <= best:
            best, at = 1 - 2 * count[s], s
        if s < capacity:
            change = np.where(count[s + 1 : capacity], 2 * (count[1 : capacity - s] - count[s + 1 : capacity]) + 2, never)
            if len(change):
                h = int(change.argmin())
                if change[h] < best or change[h] == best and at < 0:
                    at = h + s + 1
        if at < 0:
            sequence[k], offset[k], gap = opened, 0, capacity - s
            opened += 1
        else:
            sequence[k], offset[k], gap = open_at[at].pop(), capacity - at, at - s
            count[at] -= 1
        if gap:
            count[gap] += 1
            open_at[gap].append(int(sequence[k]))
    return sequence, offset


def fewest(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the lengths, and the sequence and offset of each in it."""
    falling = np.argsort(-lengths, kind="stable")
    best = falling, *sum_of_squares(lengths[falling], capacity, sparing=True)
    if best[1].max() + 1 > -(-int(lengths.sum()) // capacity):
        other = np.arange(len(lengths)), *sum_of_squares(lengths, capacity)
        best = min(best, other, key=lambda x: x[1].max())
    return best


def pack(docs: DataFrame, capacity: int = 2048, group: int = 200_000, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    cutted = cut(pieces(docs, capacity, vocabulary))
    groups = max(1, -(-cutted.count() // group))
    dealt = cutted.repartition(groups, F.xxhash64("doc_id", "ids_crc32", "length", "start", F.monotonically_increasing_id()))

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        found = pa.Table.from_batches(batches, PIECE)
        if not len(found):
            return
        # crc, id and place put the pieces into an order that is as good as random and always the same
        found = found.sort_by([(c, "ascending") for c in ("ids_crc32", "doc_id", "piece", "start", "length")])
        order, sequence, offset = fewest(found["length"].to_numpy(), capacity)
        found = found.take(pa.array(order)).append_column("sequence_id", pa.array(sequence + (TaskContext.get().partitionId() << 40))).append_column("offset", pa.array(offset))
        yield from found.cast(PLACED).to_batches(max_chunksize=50_000)

    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
