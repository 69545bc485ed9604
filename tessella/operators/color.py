"""Colour spaces, chroma sampling, palettes and running-sum predictors on pixel
relations.

All of it is whole-number arithmetic inside projections, except for the palette
and histogram operators, which aggregate per image with partial sums first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.types import invalid

from .relational import KEY, _put

# JFIF colour coefficients times 2**16.
TO_YCBCR = ((19595, 38470, 7471, 0), (-11056, -21712, 32768, 128), (32768, -27440, -5328, 128))
TO_RGB = ((0, 91881), (-22554, -46802), (116130, 0))
HALF = 1 << 15


def _byte(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), c)).cast("int")


def _bound(df: DataFrame, samples: list[Column]) -> DataFrame:
    """px of these samples, each a column of its own first: a next step that
    reads a sample several times would else be given its whole term as often,
    which made loops too long for the JVM to compile."""
    named = df.select(*(c for c in KEY if c != "px"), *(s.alias(f"_s{k}") for k, s in enumerate(samples)))
    return _put(named, px=F.array(*(F.col(f"_s{k}") for k in range(len(samples)))))


def to_ycbcr(df: DataFrame) -> DataFrame:
    rgb = [F.col("px")[k] for k in range(3)]
    return _bound(df, [_byte(F.shiftright(rgb[0] * r + rgb[1] * g + rgb[2] * b + HALF, 16) + add) for r, g, b, add in TO_YCBCR])


def to_rgb(df: DataFrame) -> DataFrame:
    y, cb, cr = F.col("px")[0] * 65536, F.col("px")[1] - 128, F.col("px")[2] - 128
    return _bound(df, [_byte(F.shiftright(y + cb * b + cr * r + HALF, 16)) for b, r in TO_RGB])


def box_shrink(df: DataFrame, across: int, down: int, channels: int) -> DataFrame:
    """Means of boxes, rounded; the last pixel of a line stands in beyond the edge."""
    w, h = F.expr(f"cast((width + {across - 1}) div {across} as int)"), F.expr(f"cast((height + {down - 1}) div {down} as int)")
    # how often a pixel counts: edge cells fill up their box
    times = F.expr(f"(1 + if(x = width - 1, {across - 1} - x % {across}, 0)) * (1 + if(y = height - 1, {down - 1} - y % {down}, 0))")
    at = df.select("image_id", w.alias("width"), h.alias("height"), F.expr(f"cast(y div {down} as int)").alias("y"), F.expr(f"cast(x div {across} as int)").alias("x"), "px", times.alias("_t"))
    sums = at.groupBy("image_id", "width", "height", "y", "x").agg(*(F.sum(F.col("px")[k] * F.col("_t")).alias(f"_{k}") for k in range(channels)))
    n = across * down
    return _put(sums, px=F.array(*(F.expr(f"cast((_{k} + {n // 2}) div {n} as int)") for k in range(channels))))


def box_repeat(df: DataFrame, across: int, down: int) -> DataFrame:
    """Every pixel repeated: the nearest-neighbour rise of subsampled chroma."""
    some = df.withColumn("_y", F.explode(F.array(*map(F.lit, range(down))))).withColumn("_x", F.explode(F.array(*map(F.lit, range(across)))))
    return _put(some, width=F.col("width") * across, height=F.col("height") * down, y=F.col("y") * down + F.col("_y"), x=F.col("x") * across + F.col("_x"))


def histogram(df: DataFrame) -> DataFrame:
    """image_id, r, g, b, n: how often each colour occurs."""
    return df.groupBy("image_id", *(F.col("px")[k].alias(c) for k, c in enumerate("rgb"))).agg(F.count(F.lit(1)).alias("n"))


def nearest_entry(df: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """image_id, y, x, idx: the closest entry of a palette of at most 256
    colours, the first of equals; each pixel is a projection, no join."""
    if not 1 <= len(palette) <= 256:
        raise invalid("a palette has 1 to 256 entries")
    px = [F.col("px")[k] for k in range(3)]
    # distance and number in one whole number, so the least is the first of the closest
    far = lambda e, i: sum(((px[k] - e[k]) * (px[k] - e[k]) for k in range(3)), F.lit(0)) * 256 + i
    if len(palette) <= 16:
        terms = [far([F.lit(v) for v in e], F.lit(i)) for i, e in enumerate(palette)]
        best = F.least(*terms) if len(terms) > 1 else terms[0]
    else:  # as terms, these would make a loop too long for the JVM to compile
        table = F.array(*(F.array(*map(F.lit, (*e, i))) for i, e in enumerate(palette)))
        best = F.array_min(F.transform(table, lambda e: far(e, e[3])))
    return df.select("image_id", "y", "x", (best % 256).cast("int").alias("idx"))


def difference_rows(df: DataFrame, channels: int) -> DataFrame:
    """Each sample less its left neighbour, modulo 256."""
    left = F.lag("px").over(Window.partitionBy("image_id", "y").orderBy("x"))
    return _put(df.withColumn("_l", left), px=F.array(*(F.pmod(F.col("px")[k] - F.coalesce(F.col("_l")[k], F.lit(0)), F.lit(256)) for k in range(channels))))


def sum_rows(df: DataFrame, channels: int) -> DataFrame:
    """The inverse of difference_rows: a running sum modulo 256."""
    line = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return _put(df, px=F.array(*((F.sum(F.col("px")[k]).over(line) % 256).cast("int") for k in range(channels))))


def difference_columns(df: DataFrame, channels: int) -> DataFrame:
    """Each sample less the one above it, modulo 256."""
    above = F.lag("px").over(Window.partitionBy("image_id", "x").orderBy("y"))
    return _put(df.withColumn("_l", above), px=F.array(*(F.pmod(F.col("px")[k] - F.coalesce(F.col("_l")[k], F.lit(0)), F.lit(256)) for k in range(channels))))


def interlace_pass(df: DataFrame) -> DataFrame:
    """image_id, y, x, pass: which of the seven passes brings a pixel."""
    even = lambda n: (F.col("y") % n == 0) & (F.col("x") % n == 0)
    number = (
        F.when(even(8), 1).when((F.col("y") % 8 == 0) & (F.col("x") % 4 == 0), 2).when(even(4), 3).when((F.col("y") % 4 == 0) & (F.col("x") % 2 == 0), 4)
        .when(even(2), 5).when(F.col("y") % 2 == 0, 6).otherwise(7)
    )
    return df.select("image_id", "y", "x", number.alias("pass"))


def quality_step(base: Column, quality: int) -> Column:
    """A quantisation step at a quality from 1 to 100."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return F.least(F.lit(255), F.greatest(F.lit(1), F.floor((base * scale + 50) / 100))).cast("int")


def bit_unpack(df: DataFrame, depth: int) -> DataFrame:
    """Bytes of packed samples of 1, 2 or 4 bits, high bits first, as 8-bit
    samples over the whole range."""
    if depth not in (1, 2, 4):
        raise invalid(f"packed samples of {depth} bits")
    each, top = 8 // depth, (1 << depth) - 1
    parts = F.array(*(F.shiftright(F.col("px")[0], 8 - depth * (k + 1)).bitwiseAND(top) for k in range(each)))
    rows = df.select("*", F.posexplode(parts).alias("_k", "_v"))
    return _put(rows, width=F.col("width") * each, x=(F.col("x") * each + F.col("_k")).cast("int"), px=F.array(F.floor((F.col("_v") * 255 + top // 2) / top).cast("int")))


def palette_expand(df: DataFrame, palette: list[tuple[int, int, int]], alpha: list[int] | None = None) -> DataFrame:
    """Indices as colours; an index outside the palette is malformed, entries
    beyond the end of alpha are opaque. The palette (256 entries at most) is a
    literal, so there is no join."""
    if not 1 <= len(palette) <= 256:
        raise invalid("a palette has 1 to 256 entries")
    table = F.array(*(F.array(*map(F.lit, e)) for e in palette))
    at = F.col("px")[0]
    wrong = F.raise_error(F.lit("malformed: an index is outside the palette")).cast("array<int>")
    color = F.when(at < len(palette), F.element_at(table, at + 1)).otherwise(wrong)
    if alpha is not None:
        known = F.array(*map(F.lit, alpha))
        color = F.concat(color, F.array(F.when(at < len(alpha), F.element_at(known, at + 1)).otherwise(255) if alpha else F.lit(255)))
    return _put(df, px=color)


def filter_choice(df: DataFrame) -> DataFrame:
    """image_id, y, filter: for each row of gray8 images the filter (0 none, 1
    left, 2 above, 3 mean, 4 nearest of left, above, corner) whose signed bytes
    have the least sum of absolute values, the first of equals."""
    line, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    zero = F.lit(0)
    rows = df.select("image_id", "y", "x", F.col("px")[0].alias("v")).withColumn("b", F.coalesce(F.lag("v").over(column), zero))
    rows = rows.withColumn("a", F.coalesce(F.lag("v").over(line), zero)).withColumn("c", F.coalesce(F.lag("b").over(line), zero))
    a, b, c, v = (F.col(n) for n in "abcv")
    pa, pb, pc = F.abs(b - c), F.abs(a - c), F.abs(a + b - 2 * c)
    near = F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)

    def size(guess: Column) -> Column:
        byte = F.pmod(v - guess, F.lit(256))
        return F.sum(F.when(byte > 127, 256 - byte).otherwise(byte))

    guesses = (zero, a, b, F.floor((a + b) / 2).cast("int"), near)
    sums = rows.groupBy("image_id", "y").agg(*(size(g).alias(f"s{k}") for k, g in enumerate(guesses)))
    least = F.least(*(F.struct(F.col(f"s{k}").alias("s"), F.lit(k).alias("k")) for k in range(5)))
    return sums.select("image_id", "y", least["k"].alias("filter"))


def tile_grid(sizes: DataFrame, tile_width: int, tile_height: int, x: int, y: int, width: int, height: int) -> DataFrame:
    """image_id, chunk, x, y: the chunks of each image's grid that a region
    touches; sizes: image_id, width, height. Only those are listed."""
    if min(tile_width, tile_height, width, height) <= 0 or min(x, y) < 0:
        raise invalid(f"region {width}x{height}+{x}+{y}, tiles {tile_width}x{tile_height}")
    across = F.floor((F.col("width") + tile_width - 1) / tile_width).cast("int")
    last = lambda size, end, step: F.floor((F.least(F.col(size), F.lit(end)) - 1) / step).cast("int")
    inside = sizes.filter((F.col("width") > x) & (F.col("height") > y))
    rows = inside.select("image_id", across.alias("_n"), F.explode(F.sequence(F.lit(y // tile_height), last("height", y + height, tile_height))).alias("_r"), "width")
    rows = rows.select("image_id", "_n", "_r", F.explode(F.sequence(F.lit(x // tile_width), last("width", x + width, tile_width))).alias("_c"))
    return rows.select("image_id", (F.col("_r") * F.col("_n") + F.col("_c")).alias("chunk"), (F.col("_c") * tile_width).alias("x"), (F.col("_r") * tile_height).alias("y"))
