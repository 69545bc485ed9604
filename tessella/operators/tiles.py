"""The array lowering: images as rows of packed bytes.

A row is one image (or one tile of it): ``image_id, width, height, pixel,
data``. Chains of operations run in one Arrow stage, on stacks of all images of
a batch that have one shape; nothing is shuffled and nothing grows beyond a
batch.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.types import LAYOUTS, Descriptor, RasterError, descriptor_of, to_array

IMAGE = "image_id long, width int, height int, pixel string, data binary"
SCHEMA = pa.schema([("image_id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("pixel", pa.string()), ("data", pa.binary())])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)


def stacks(batch: pa.RecordBatch):
    """(ids, stack) for each shape of a batch."""
    groups: dict[tuple, list[int]] = defaultdict(list)
    for k, key in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
        groups[key].append(k)
    data = batch.column(4)
    for (width, height, name), at in groups.items():
        d = Descriptor(width, height, name)
        whole = b"".join(data[k].as_buffer().to_pybytes() for k in at)
        if len(whole) != d.row_bytes * height * len(at):
            raise RasterError("invalid_argument", f"data does not fit {width}x{height} {name}")
        yield batch.column(0).take(pa.array(at)).to_pylist(), np.frombuffer(whole, LAYOUTS[name].dtype).reshape(len(at), *d.shape)


def apply(df: DataFrame, chain: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Run a function from stack to stack over image rows."""

    def run(batches):
        for b in batches:
            rows = []
            for ids, stack in stacks(b):
                out = np.ascontiguousarray(chain(stack))
                d = descriptor_of(out[0])
                rows += [(i, d.width, d.height, d.pixel, a.tobytes()) for i, a in zip(ids, out)]
            yield batch_of(rows)

    return df.select("image_id", "width", "height", "pixel", "data").mapInArrow(run, IMAGE)


def _gathered(df: DataFrame) -> DataFrame:
    """image_id, width, height, rows: the pixels of each image, in any order."""
    return df.groupBy("image_id", "width", "height").agg(F.collect_list(F.struct("y", "x", "px")).alias("rows"))


def packed(batch: pa.RecordBatch, dtype: str) -> list[tuple[int, int, int, int, bytes]]:
    """(image_id, width, height, channels, data) of a batch of `_gathered`: all
    pixels of the batch are put on their places at once."""
    ids, (w, h) = batch.column(0).to_pylist(), (batch.column(k).to_numpy().astype(np.int64) for k in (1, 2))
    each, pixels = batch.column(3).value_lengths().to_numpy(), batch.column(3).flatten()
    wide = pixels.field(2).value_lengths().to_numpy(zero_copy_only=False)
    if (each != w * h).any() or not (wide > 0).all():
        raise RasterError("invalid_argument", "an image lacks pixels or has some twice")
    if not len(ids):
        return []
    ends = np.cumsum(each)
    channels = wide[ends - 1].astype(np.int64)
    flat = pixels.field(2).flatten().to_numpy(zero_copy_only=False)
    kind = np.dtype(dtype)
    if kind.kind == "u" and len(flat) and (flat.min() < 0 or flat.max() > np.iinfo(kind).max):
        raise RasterError("invalid_argument", f"a sample does not fit {kind}")
    y, x = (pixels.field(k).to_numpy() for k in (0, 1))
    across = np.repeat(w, each)
    if (y < 0).any() or (x < 0).any() or (x >= across).any() or (y >= np.repeat(h, each)).any():
        raise RasterError("invalid_argument", "a pixel is outside its image")
    at, seen = y * across + x + np.repeat(ends - each, each), np.zeros(len(y), bool)
    seen[at] = True
    if not seen.all() or (wide != np.repeat(channels, each)).any():
        raise RasterError("invalid_argument", "an image lacks pixels or has some twice")
    starts = np.cumsum(channels * each) - channels * each
    if (channels == channels[0]).all():
        out = np.empty((len(y), int(channels[0])), kind)
        out[at] = flat.reshape(out.shape)
        whole = out.tobytes()
    else:
        first = np.repeat(starts, each) + (at - np.repeat(ends - each, each)) * wide  # of each pixel's samples
        out = np.empty(len(flat), kind)
        out[np.repeat(first - (np.cumsum(wide) - wide), wide) + np.arange(len(flat))] = flat
        whole = out.tobytes()
    step = kind.itemsize
    return [(i, int(a), int(b), int(c), whole[s * step : (s + n * c) * step]) for i, a, b, c, s, n in zip(ids, w, h, channels, starts.tolist(), each.tolist())]


def from_samples(df: DataFrame, pixel: str) -> DataFrame:
    """A pixel relation as image rows; one shuffle, by image."""
    dtype = LAYOUTS[pixel].dtype

    def run(batches):
        for b in batches:
            yield batch_of([(i, w, h, pixel, data) for i, w, h, _, data in packed(b, dtype)])

    return _gathered(df).mapInArrow(run, IMAGE)


def to_samples(df: DataFrame) -> DataFrame:
    """image_id, y, x, c, v of image rows (8- and 16-bit samples)."""

    def run(batches):
        for b in batches:
            for ids, stack in stacks(b):
                n, h, w, c = stack.shape
                places = (np.tile(g.ravel(), n) for g in np.indices((h, w, c), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), h * w * c)), *map(pa.array, places), pa.array(stack.ravel().astype(np.int32))], names=["image_id", "y", "x", "c", "v"])

    return df.mapInArrow(run, "image_id long, y int, x int, c int, v int")


def to_relation(df: DataFrame) -> DataFrame:
    """Image rows of one layout as pixel rows: image_id, width, height, y, x, px."""

    def run(batches):
        for b in batches:
            for ids, stack in stacks(b):
                n, h, w, c = stack.shape
                i, y, x = (g.ravel() for g in np.meshgrid(np.array(ids), np.arange(h), np.arange(w), indexing="ij"))
                flat = stack.ravel()
                values = pa.array(flat.astype(np.float32)) if flat.dtype.kind == "f" else pa.array(flat.astype(np.int32)).cast(pa.float32()) if floating else pa.array(flat.astype(np.int32))
                px = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, c, dtype=np.int32)), values)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), *(pa.array(np.full(len(i), v, np.int32)) for v in (w, h)), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), px], names=["image_id", "width", "height", "y", "x", "px"])

    first = df.select("pixel").first()
    floating = first is not None and LAYOUTS[first.pixel].dtype[-2:] == "f4"
    return df.mapInArrow(run, f"image_id long, width int, height int, y int, x int, px array<{'float' if floating else 'int'}>")


def from_relation(df: DataFrame) -> DataFrame:
    """Pixel rows of 8-bit samples as image rows, whatever their channels."""
    names = {p.channels: p.name for p in LAYOUTS.values() if p.dtype == "u1"}

    def run(batches):
        for b in batches:
            yield batch_of([(i, w, h, names[c], data) for i, w, h, c, data in packed(b, "u1")])

    return _gathered(df).mapInArrow(run, IMAGE)


def decode_row(width: int, height: int, pixel: str, data: bytes) -> np.ndarray:
    return to_array(data, Descriptor(width, height, pixel))
