"""The relational lowering: images as a relation of cells.

A row is one pixel: ``image_id, width, height, y, x, px`` with px the array of
its samples. Geometry and point operations are projections and filters that
need no shuffle. Resampling and convolution join or generate taps inside the
scan's stage and sum them; partial aggregation folds an image's taps where its
cells lie, so only output cells are shuffled. All arithmetic on 8-bit samples
is in whole numbers, so results do not depend on partitions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.types import RasterError, invalid
from tessella.functions.weights import Kernel, weights
from tessella.operators.kernels import Modulate, quarter_turns

KEY = ("image_id", "width", "height", "y", "x", "px")


def _put(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*(columns.get(c, F.col(c)).alias(c) for c in KEY))


def _int(c: Column) -> Column:
    return c.cast("int")


def crop(df, x: int, y: int, width: int, height: int):
    """Images that the window does not fit into raise invalid_argument."""
    if width <= 0 or height <= 0 or x < 0 or y < 0:
        raise invalid(f"crop {width}x{height}+{x}+{y}")
    inside = F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)  # on bare columns, so that a scan can use it
    fits = (F.col("width") >= x + width) & (F.col("height") >= y + height)
    checked = F.when(fits, F.col("x") - x).otherwise(F.raise_error(F.lit("invalid_argument: the crop is outside the image")).cast("int"))
    return _put(df.filter(inside | ~fits), x=_int(checked), y=_int(F.col("y") - y), width=F.lit(width), height=F.lit(height))


def flip(df):
    return _put(df, y=_int(F.col("height") - 1 - F.col("y")))


def flop(df):
    return _put(df, x=_int(F.col("width") - 1 - F.col("x")))


def rotate(df, degrees: int):
    q = quarter_turns(degrees)
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    if q == 0:
        return df
    if q == 2:
        return flip(flop(df))
    if q == 1:
        return _put(df, width=h, height=w, x=_int(h - 1 - y), y=x)
    return _put(df, width=h, height=w, x=y, y=_int(w - 1 - x))


def extract_channel(df, index: int, channels: int | None = None):
    if index < 0 or (channels is not None and index >= channels):
        raise invalid(f"channel {index}")
    if df.schema["px"].dataType.elementType.typeName() == "float":
        raise RasterError("unsupported", "there is no gray format of floats")
    return _put(df, px=F.array(F.element_at("px", index + 1)))


def flatten(df, background: tuple[int, int, int], channels: int, full: int = 255):
    _only_8_bits(df, full)
    if channels in (1, 3):
        return df
    a = F.col("px")[channels - 1]
    color = [_int(F.floor((F.col("px")[k] * a + background[k] * (255 - a) + 127) / 255)) for k in range(channels - 1)]
    return _put(df, px=F.array(*color))


def _f(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("float")


def modulate(df, m: Modulate, channels: int, full: int = 255):
    """Every step is rounded to single precision."""
    real = floats(df)
    scaled = [_f(F.col("px")[k]) if real else _f(_f(F.col("px")[k]) / _f(full)) for k in range(channels)]
    alpha = [F.col("px")[channels - 1]] if channels in (2, 4) else []

    def clamp(c: Column) -> Column:
        return F.greatest(_f(0), F.least(_f(1), c))

    def store(c: Column) -> Column:
        return clamp(c) if real else _int(F.floor(_f(_f(clamp(c) * _f(full)) + _f(0.5))))

    if channels < 3:
        return _put(df, px=F.array(store(_f(scaled[0] * _f(m.brightness))), *alpha))
    part = lambda p, q, d, add: _f(_f(60) * _f(_f(_f(p - q) / d) + _f(add)))
    eps, z = _f(2.0**-23), _f(0)

    def spread(c):
        r, g, b = c["r"], c["g"], c["b"]
        return F.struct(r.alias("r"), g.alias("g"), b.alias("b"), F.greatest(r, g, b).alias("t"), _f(F.greatest(r, g, b) - F.least(r, g, b)).alias("d"))

    def polar(c):
        r, g, b, t, d = (c[n] for n in "rgbtd")
        hue = F.when(d <= eps, z).when(t == r, _f(_f(60) * _f(_f(_f(g - b) / d) % _f(6)))).when(t == g, part(b, r, d, 2)).otherwise(part(r, g, d, 4))
        sat = F.when(t <= eps, z).otherwise(_f(d / t))
        return F.struct(_f(_f(hue + _f(m.hue)) % _f(360)).alias("h"), clamp(_f(sat * _f(m.saturation))).alias("s"), clamp(_f(t * _f(m.brightness))).alias("v"))

    def sector(c):
        h = F.when(c["h"] < 0, _f(c["h"] + _f(360))).otherwise(c["h"])
        return F.struct(_f(h / _f(60)).alias("k"), _f(c["v"] * c["s"]).alias("c"), c["v"].alias("v"))

    def edges(c):
        x = _f(c["c"] * _f(_f(1) - F.abs(_f(_f(c["k"] % _f(2)) - _f(1)))))
        return F.struct(c["c"].alias("c"), x.alias("x"), _f(c["v"] - c["c"]).alias("m"), F.least(F.lit(5), _int(F.floor(c["k"]))).alias("n"))

    def colors(e):
        c, x, n = e["c"], e["x"], e["n"]
        pick = lambda *of: F.when(n == 0, of[0]).when(n == 1, of[1]).when(n == 2, of[2]).when(n == 3, of[3]).when(n == 4, of[4]).otherwise(of[5])
        return F.array(*(store(_f(v + e["m"])) for v in (pick(c, x, z, z, x, c), pick(x, c, c, x, z, z), pick(z, z, x, c, c, x))))

    # a transform binds each intermediate once; as projections they would be inlined into expressions of many thousand terms
    made = F.array(F.struct(*(scaled[k].alias(n) for k, n in enumerate("rgb"))))
    for step in (spread, polar, sector, edges, colors):
        made = F.transform(made, step)
    return _put(df, px=F.concat(made[0], F.array(*alpha)) if alpha else made[0])


def floats(df: DataFrame) -> bool:
    return df.schema["px"].dataType.elementType.typeName() in ("float", "double")


def _only_8_bits(df: DataFrame, full: int) -> None:
    if floats(df) or full != 255:
        raise RasterError("unsupported", "this operation takes 8-bit samples only")


def _sums(df: DataFrame, by: list[str], channels: int, full: int) -> DataFrame:
    """Weighted sums: q (fixed point) for 8-bit samples, w (exact) for others."""
    narrow = full == 255 and not floats(df)
    total = [F.sum(F.col("px")[k].cast("long") * F.col("q") if narrow else F.col("px")[k].cast("double") * F.col("w")).alias(f"_{k}") for k in range(channels)]

    def value(c: Column) -> Column:
        if floats(df):
            return c.cast("float")
        return _int(F.greatest(F.lit(0), F.least(F.lit(full), F.shiftright(c + 8192, 14) if narrow else F.floor(c + 0.5))))

    rounded = F.array(*(value(F.col(f"_{k}")) for k in range(channels)))
    return df.groupBy("image_id", "width", "height", *by).agg(*total).withColumn("px", rounded)


def convolve(df, kernel: Kernel, channels: int, full: int = 255):
    """Each pixel is handed to every output it is a tap of. The first and last
    pixel of a line also stand in for the taps beyond the edge: there is a table
    of weights for each of the 16 cases (inside, first, last, both; of rows and
    of columns), so a pixel meets an output once, with the sum of its taps."""
    ry, rx = kernel.height // 2, kernel.width // 2
    narrow = full == 255 and not floats(df)
    used = (kernel.fixed if narrow else kernel.exact) != 0
    if not used.any():
        return _put(df, px=F.array(*[F.lit(0).cast(df.schema["px"].dataType.elementType)] * channels))

    def cases(r: int) -> list[np.ndarray]:
        """[e, d]: whether a pixel e beyond an output is what its tap d reads."""
        e, d = np.mgrid[-r : r + 1, -r : r + 1]
        return [(m & (e == 0) if k == 3 else m).astype(np.int64) for k, m in enumerate((d == e, d <= e, d >= e, d >= -r))]

    taps = []
    for cy, down in enumerate(cases(ry)):
        for cx, across in enumerate(cases(rx)):
            q, w, some = (down @ k @ across.T for k in (kernel.fixed.astype(np.int64), np.asarray(kernel.exact, float), used.astype(np.int64)))
            taps += [(cy * 4 + cx, int(y) - ry, int(x) - rx, int(q[y, x]), float(w[y, x])) for y, x in zip(*np.nonzero(some))]
    table = df.sparkSession.createDataFrame(taps, "case int, dy int, dx int, q long, w double")
    case = F.expr("4 * (if(y = 0, 1, 0) + if(y = height - 1, 2, 0)) + if(x = 0, 1, 0) + if(x = width - 1, 2, 0)")
    spread = df.withColumn("_case", case).join(F.broadcast(table), F.col("_case") == F.col("case"))  # at most 16 x 63 x 63 rows
    spread = spread.withColumn("_y", F.col("y") - F.col("dy")).withColumn("_x", F.col("x") - F.col("dx")).filter("_y between 0 and height - 1 and _x between 0 and width - 1")
    out = _sums(spread, ["_y", "_x"], channels, full)
    return _put(out, y=F.col("_y"), x=F.col("_x"))


def resize(df, width: int, height: int, name: str, channels: int, sizes: tuple[list[int], list[int]] | None = None, full: int = 255):
    """sizes: the widths and heights that occur (None: they are looked up). A
    size that is not among them raises invalid_argument; a weight table has a
    row for each input that an output uses, 2,000,000 at most."""
    spark, narrow = df.sparkSession, full == 255 and not floats(df)
    if sizes is None:
        found = df.select("width", "height").distinct().agg(F.collect_set("width"), F.collect_set("height")).first()
        sizes = (found[0], found[1])

    def table(all_sizes, out):
        rows = [(s, o, i, q, w) for s in sorted(set(all_sizes)) for o, i, q, w in weights(name, s, out).rows() if (q if narrow else w)]
        if len(rows) > 2_000_000:
            raise RasterError("limit_exceeded", "too many different sizes for one weight table")
        return F.broadcast(spark.createDataFrame(rows, "s int, o int, i int, q long, w double"))

    def known(size, all_sizes):
        wrong = F.raise_error(F.concat(F.lit(f"invalid_argument: {size} "), F.col(size), F.lit(" is not among the sizes"))).cast("int")
        return F.when(F.col(size).isin(*sorted(set(all_sizes))), F.col(size)).otherwise(wrong)

    if not sizes[0] or not sizes[1]:
        return _put(df, width=F.lit(width), height=F.lit(height))
    across = df.withColumn("width", known("width", sizes[0])).join(table(sizes[0], width), (F.col("width") == F.col("s")) & (F.col("x") == F.col("i")))
    df = _put(_sums(across, ["y", "o"], channels, full), x=F.col("o"), width=F.lit(width))
    down = df.withColumn("height", known("height", sizes[1])).join(table(sizes[1], height), (F.col("height") == F.col("s")) & (F.col("y") == F.col("i")))
    return _put(_sums(down, ["o", "x"], channels, full), y=F.col("o"), height=F.lit(height))


def composite(base, overlay, dx: int, dy: int, blend: str, channels: int, full: int = 255):
    """The overlay joins the base on its place; overlay cells that miss the
    canvas are dropped before the join."""
    if blend not in ("over", "source"):
        raise invalid(f"no blend {blend!r}")
    _only_8_bits(base, full)
    over = overlay.select("image_id", _int(F.col("x") + dx).alias("x"), _int(F.col("y") + dy).alias("y"), F.col("px").alias("over")).filter("x >= 0 and y >= 0")
    both = base.join(over, ["image_id", "y", "x"], "left")
    if blend == "source" or channels in (1, 3):
        return _put(both, px=F.coalesce("over", "px"))
    s, b = F.col("over"), F.col("px")
    sa, rest = s[channels - 1].cast("long"), b[channels - 1].cast("long") * (255 - s[channels - 1])
    total = sa * 255 + rest
    color = [_int(F.least(F.lit(255), F.expr(f"(over[{k}] * cast(over[{channels - 1}] as bigint) * 255 + px[{k}] * _rest + _total div 2) div _total"))) for k in range(channels - 1)]
    both = both.withColumn("_rest", rest).withColumn("_total", total)
    mixed = F.when(F.col("_total") == 0, F.array(*[F.lit(0)] * channels)).otherwise(F.array(*color, _int(F.least(F.lit(255), F.expr("(_total + 127) div 255")))))
    return _put(both, px=F.when(F.col("over").isNull(), F.col("px")).otherwise(mixed))


def saturating_sum(a, b, channels: int):
    other = b.select("image_id", "y", "x", F.col("px").alias("more"))
    return _put(a.join(other, ["image_id", "y", "x"]), px=F.array(*(F.least(F.lit(255), F.col("px")[k] + F.col("more")[k]) for k in range(channels))))


def samples(df: DataFrame) -> DataFrame:
    """image_id, y, x, c, v. For a bare column Spark would put a filter on its
    size in front and move that down, where it works out every step again."""
    return df.select("image_id", "y", "x", F.posexplode(F.concat("px")).alias("c", "v"))
