"""Lazy pipelines: a chain of operations on every image of a collection.

A Raster holds steps, not cells; nothing is read before a result is asked for.
The first error of a chain is kept and raised by the terminal, and later steps
are not looked at. A chain lowers to one Arrow stage over image rows
(`images`); `operators.relational` says the same of pixel rows, in SQL terms,
and `relation` lowers a chain to it.

Files are decoded in the stage that runs the chain. A first crop reads only the
tiles or strips of a TIFF that it touches; a first resize decodes a JPEG at the
coarsest of 1, 1/2, 1/4 and 1/8 that is still as large as the target.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import codecs
from tessella.codecs import jpeg, raw, tiff
from tessella.functions.types import Descriptor, EncodeOptions, Limits, RasterError, Region, descriptor_of, invalid, pixel
from tessella.functions.weights import Kernel, fit, weights
from tessella.operators import kernels, relational, tiles
from tessella.sources import sniff

# functions, not their module, so that a chain travels to the executors by value
KERNELS = {f.__name__: f for f in (kernels.crop, kernels.flip, kernels.flop, kernels.rotate, kernels.extract_channel, kernels.flatten, kernels.modulate, kernels.convolve)}


def load(content: bytes, steps: tuple, limits: Limits, shrink: bool) -> tuple[np.ndarray, tuple, tuple[int, int] | None]:
    """The samples of a file, the steps left to do, and the size that a first
    resize goes by where the samples are fewer than that."""
    name, (first, args) = sniff.format_of(content), steps[0] if steps else ("", ())
    if name == "tiff" and first == "crop":
        x, y, width, height = args
        f = tiff.layout(content, limits)
        if x + width <= f.width and y + height <= f.height:
            return tiff.decode(content, limits, Region(x, y, width, height)), steps[1:], None
    if name == "jpeg" and first == "resize_to" and shrink and not jpeg.is_progressive(content):
        size = codecs.size_of(content)
        return jpeg.decode(content, limits, jpeg.fitting(*size, *fit(*size, args[0], args[1], args[3], args[4]))), steps, size
    return codecs.decode(content, limits), steps, None


def run_steps(stack: np.ndarray, steps: tuple, known: dict, size: tuple[int, int] | None = None) -> np.ndarray:
    """size: what a first resize goes by, if the stack is a reduced decode."""
    for name, args in steps:
        if name == "resize_to":
            width, height, how_filter, how, enlarge = args
            w, h = fit(*(size or (stack.shape[2], stack.shape[1])), width, height, how, enlarge)
            stack = kernels.resize(stack, w, h, how_filter)
        elif name == "apply":
            stack = args[0](stack)
        else:
            stack = known[name](stack, *args)
        size = None
    return stack


@dataclass(frozen=True)
class Raster:
    """rows: image rows (image_id, width, height, pixel, data); or files
    (image_id, path, content), which the terminal decodes. headers: image_id,
    width, height and pixel, where they are known without the samples."""

    rows: DataFrame | None
    steps: tuple = ()
    error: RasterError | None = None
    files: DataFrame | None = None
    headers: DataFrame | None = None
    limits: Limits = Limits()
    shrink: bool = True

    @staticmethod
    def open(spark: SparkSession, path: str, limits: Limits = Limits(), shrink: bool = True) -> Raster:
        """All files below a path, known by content; image_id is a hash of the path."""
        files = sniff.scan(spark, path).select(F.xxhash64("path").alias("image_id"), "path", "content")
        return Raster(None, files=files, limits=limits, shrink=shrink)

    @staticmethod
    def from_raw(images: DataFrame, d: Descriptor, stride: int | None = None, limits: Limits = Limits()) -> Raster:
        """images: image_id, data. Packed rows of one layout have to fit exactly;
        with a stride, rows are padded to it and more bytes may follow."""
        limits.check(d.width, d.height)

        def run(batches):
            for b in batches:
                rows = []
                for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if stride is None and len(data) != d.row_bytes * d.height:
                        raise invalid(f"image {i}: {len(data)} bytes for {d.width}x{d.height} {d.pixel}, which needs {d.row_bytes * d.height}")
                    rows.append((i, d.width, d.height, d.pixel, raw.decode(data, d, stride, limits).tobytes()))
                yield tiles.batch_of(rows)

        return Raster(images.select("image_id", "data").mapInArrow(run, tiles.IMAGE))

    @staticmethod
    def from_raw_stream(spark: SparkSession, path: str, d: Descriptor, stride: int | None = None) -> Raster:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return Raster.from_raw(files.select(F.xxhash64("path").alias("image_id"), F.col("content").alias("data")), d, d.row_bytes if stride is None else stride)

    def apply(self, step: Callable[[np.ndarray], np.ndarray]) -> Raster:
        """An operation of the caller's, from stack to stack (images, rows, columns, channels)."""
        return self._then("apply", lambda: None, step)

    def combine(self, other: Raster, step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Raster:
        """An operation on two images with one image_id; images without a partner go."""
        if self.error or other.error:
            return replace(self, error=self.error or other.error)
        more = other.images().select("image_id", *(F.col(c).alias(f"other_{c}") for c in ("width", "height", "pixel", "data")))
        both = self.images().join(more, "image_id")

        def run(batches):
            for b in batches:
                rows = []
                for i, *x in zip(*(b.column(k).to_pylist() for k in range(9))):
                    out = step(*(tiles.decode_row(*x[k : k + 4])[None] for k in (0, 4)))[0]
                    d = descriptor_of(out)
                    rows.append((i, d.width, d.height, d.pixel, np.ascontiguousarray(out).tobytes()))
                yield tiles.batch_of(rows)

        return Raster(both.mapInArrow(run, tiles.IMAGE))

    def composite(self, overlay: Raster, x: int = 0, y: int = 0, blend: str = "over") -> Raster:
        if blend not in ("over", "source"):
            return replace(self, error=self.error or invalid(f"no blend {blend!r}"))
        return self.combine(overlay, lambda base, over: kernels.composite(base, over, x, y, blend))

    def node_count(self) -> int:
        """Sources and steps of the chain."""
        return 1 + len(self.steps)

    def demand(self, width: int, height: int, region: Region) -> list[tuple[str, Region]]:
        """Backwards from a region of the result, what each step needs of its
        input; the last entry is what is read of an image of this size."""
        sizes = [(width, height)]
        for name, args in self.steps:
            w, h = sizes[-1]
            if name == "crop":
                w, h = args[2:]
            elif name == "rotate" and kernels.quarter_turns(args[0]) % 2:
                w, h = h, w
            elif name == "resize_to":
                w, h = fit(w, h, args[0], args[1], args[3], args[4])
            sizes.append((w, h))
        out = [("result", region)]
        for (name, args), (w, h), (ow, oh) in zip(reversed(self.steps), sizes[-2::-1], sizes[:0:-1]):
            r = out[-1][1]
            if name == "crop":
                r = replace(r, x=r.x + args[0], y=r.y + args[1])
            elif name == "flip":
                r = replace(r, y=h - r.bottom)
            elif name == "flop":
                r = replace(r, x=w - r.right)
            elif name == "rotate":
                turns = kernels.quarter_turns(args[0])
                if turns == 1:
                    r = Region(r.y, h - r.right, r.height, r.width)
                elif turns == 2:
                    r = Region(w - r.right, h - r.bottom, r.width, r.height)
                elif turns == 3:
                    r = Region(w - r.bottom, r.x, r.height, r.width)
            elif name == "convolve":
                rx, ry = args[0].width // 2, args[0].height // 2
                r = Region(r.x - rx, r.y - ry, r.width + 2 * rx, r.height + 2 * ry).intersect(Region(0, 0, w, h))
            elif name == "resize_to":
                x0, x1 = weights(args[2], w, ow).span(r.x, r.right)
                y0, y1 = weights(args[2], h, oh).span(r.y, r.bottom)
                r = Region(x0, y0, x1 - x0, y1 - y0)
            elif name == "apply":
                r = Region(0, 0, w, h)
            out.append((name, r))
        return out

    def explain_regions(self, width: int, height: int, region: Region) -> str:
        return "\n".join(f"{name}: {r}" for name, r in self.demand(width, height, region))

    def output(self, name: str, options: EncodeOptions = EncodeOptions()) -> Output:
        """Chooses an encoder; nothing runs yet."""
        if name not in codecs.ENCODERS:
            return Output(replace(self, error=self.error or RasterError("unsupported", f"{name} files cannot be written here")), name, options)
        return Output(self, name, options)

    def _then(self, name: str, check, *args) -> Raster:
        if self.error is not None:
            return self
        try:
            check()
        except RasterError as e:
            return replace(self, error=e)
        return replace(self, steps=(*self.steps, (name, args)))

    def crop(self, x: int, y: int, width: int, height: int) -> Raster:
        def check():
            if width <= 0 or height <= 0 or x < 0 or y < 0:
                raise invalid(f"crop {width}x{height}+{x}+{y}")

        return self._then("crop", check, x, y, width, height)

    def flip(self) -> Raster:
        return self._then("flip", lambda: None)

    def flop(self) -> Raster:
        return self._then("flop", lambda: None)

    def rotate(self, degrees: int) -> Raster:
        return self._then("rotate", lambda: kernels.quarter_turns(degrees), degrees)

    def extract_channel(self, index: int) -> Raster:
        return self._then("extract_channel", lambda: None, index)

    def flatten(self, red: int, green: int, blue: int) -> Raster:
        return self._then("flatten", lambda: None, (red, green, blue))

    def modulate(self, brightness: float = 1.0, saturation: float = 1.0, hue: float = 0.0) -> Raster:
        try:
            m = kernels.Modulate(brightness, saturation, hue)
        except RasterError as e:
            return replace(self, error=self.error or e)
        return self._then("modulate", lambda: None, m)

    def convolve(self, kernel: Kernel) -> Raster:
        return self._then("convolve", lambda: None, kernel)

    def _kernel(self, make) -> Raster:
        try:
            return self.convolve(make())
        except RasterError as e:
            return replace(self, error=self.error or e)

    def blur(self, sigma: float) -> Raster:
        return self._kernel(lambda: Kernel.gaussian(sigma))

    def sharpen(self, amount: float) -> Raster:
        return self._kernel(lambda: Kernel.sharpen(amount))

    def resize(self, width: int, height: int, filter: str = "lanczos3", how: str = "fill", enlarge: bool = True) -> Raster:
        return self._then("resize_to", lambda: fit(1, 1, width, height, how, enlarge), width, height, filter, how, enlarge)

    def thumbnail(self, width: int, height: int) -> Raster:
        """Inside the box, never larger than the image."""
        return self.resize(width, height, how="inside", enlarge=False)

    def metadata(self) -> DataFrame:
        """image_id, width, height and pixel of the inputs, without their bytes;
        of files, path, width and height from their headers."""
        if self.files is not None:

            def run(batches):
                for b in batches:
                    sizes = [codecs.size_of(c) for c in b.column(2).to_pylist()]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([s[k] for s in sizes], pa.int32()) for k in (0, 1))], names=["image_id", "path", "width", "height"])

            return self.files.mapInArrow(run, "image_id long, path string, width int, height int")
        return (self.rows if self.headers is None else self.headers).select("image_id", "width", "height", "pixel")

    def images(self) -> DataFrame:
        """The results as image rows."""
        if self.error is not None:
            raise self.error
        steps, known, limits, shrink = self.steps, KERNELS, self.limits, self.shrink
        if self.files is not None:

            def run(batches):
                for b in batches:
                    rows = []
                    for i, path, content in zip(*(b.column(k).to_pylist() for k in range(3))):
                        try:
                            a, left, size = load(content, steps, limits, shrink)
                            out = np.ascontiguousarray(run_steps(a[None], left, known, size)[0])
                        except RasterError as e:
                            raise RasterError(e.code, f"{path}: {e.detail}") from None
                        d = descriptor_of(out)
                        rows.append((i, d.width, d.height, d.pixel, out.tobytes()))
                    yield tiles.batch_of(rows)

            return self.files.mapInArrow(run, tiles.IMAGE)
        return tiles.apply(self.rows, lambda stack: run_steps(stack, steps, known)) if steps else self.rows

    def relation(self) -> DataFrame:
        """The same chain over pixel rows, image by image of one layout; for a
        resize, inside a box is not said there."""
        if self.error is not None:
            raise self.error
        rows = replace(self, steps=()).images()
        names = [r.pixel for r in rows.select("pixel").distinct().limit(2).collect()]
        if len(names) > 1:
            raise RasterError("unsupported", "a relation holds one layout")
        p = pixel(names[0]) if names else pixel("gray8")
        full, n = {"u1": 255, "u2": 65535, "f4": 255}[p.dtype[-2:]], p.channels
        df = tiles.to_relation(rows)
        for name, args in self.steps:
            if name in ("crop", "flip", "flop", "rotate"):
                df = getattr(relational, name)(df, *args)
            elif name == "extract_channel":
                df, n = relational.extract_channel(df, args[0], n), 1
            elif name == "flatten":
                df, n = relational.flatten(df, args[0], n, full), n - (n in (2, 4))
            elif name in ("modulate", "convolve"):
                df = getattr(relational, name)(df, args[0], n, full)
            elif name == "resize_to" and args[3] == "fill" and args[4]:
                df = relational.resize(df, args[0], args[1], args[2], n, full=full)
            else:
                raise RasterError("unsupported", f"{name} {args} is not said of pixel rows")
        return df

    def samples(self) -> DataFrame:
        """image_id, y, x, c, v of the results."""
        return tiles.to_samples(self.images())


@dataclass(frozen=True)
class RunStats:
    images: int
    bytes: int
    seconds: float


@dataclass(frozen=True)
class Output:
    """A chain and the format its results are written in."""

    raster: Raster
    format: str
    options: EncodeOptions = EncodeOptions()

    def bytes(self) -> DataFrame:
        """image_id, format, data: each result as a file's bytes."""
        return self._encoded(self.raster.images())

    def bytes_via_reference(self) -> DataFrame:
        """As bytes(), by way of pixel rows: slow, for comparison."""
        return self._encoded(tiles.from_relation(self.raster.relation()))

    def _encoded(self, images: DataFrame) -> DataFrame:
        name, options = self.format, self.options

        def run(batches):
            for b in batches:
                made = [codecs.encode(tiles.decode_row(*x), name, options) for x in zip(*(b.column(k).to_pylist() for k in range(1, 5)))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * len(made), pa.string()), pa.array(made, pa.binary())], names=["image_id", "format", "data"])

        return images.mapInArrow(run, "image_id long, format string, data binary")

    def write(self, folder: str) -> DataFrame:
        """Writes image_id.format files to a folder that all executors share, and
        gives image_id, path, bytes. A file appears whole or not at all, so a
        task that runs again does no harm."""
        name = self.format

        def run(batches):
            os.makedirs(folder, exist_ok=True)
            for b in batches:
                paths, sizes = [], []
                for i, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                    path = os.path.join(folder, f"{i}.{name}")
                    with open(part := f"{path}.{os.getpid()}.part", "wb") as f:
                        f.write(data)
                    os.replace(part, path)
                    paths.append(path)
                    sizes.append(len(data))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["image_id", "path", "bytes"])

        return self.bytes().mapInArrow(run, "image_id long, path string, bytes long")

    def write_with_stats(self, folder: str) -> RunStats:
        start = time.perf_counter()
        n, size = self.write(folder).agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        return RunStats(n, size, time.perf_counter() - start)
