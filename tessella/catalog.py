"""The raster query catalogue: Spark queries and their DuckDB twins.

Images are the rasters of `sources.fixtures`. Every query gives samples
(image_id, y, x, c, v) unless its name says otherwise.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import codecs
from tessella.codecs import gif, png, raw, tiff
from tessella.functions.types import Descriptor, EncodeOptions, descriptor_of
from tessella.functions.weights import FILTERS, Kernel, weights
from tessella.operators import color, frames, kernels, relational as R, tiles
from tessella.plans import Raster
from tessella.sources import fixtures, sniff

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _ctes(source: str, steps: list[str], last: str = "SELECT image_id, y, x, c, CAST(v AS INT) AS v FROM s{n}") -> str:
    """s0: the source's samples; s1, s2, ...: what each step makes of s{n-1}."""
    out = [f"s0 AS MATERIALIZED ({fixtures.SQL[source]})"] + [f"s{k + 1} AS MATERIALIZED ({s.replace('{s}', f's{k}')})" for k, s in enumerate(steps)]
    return "WITH " + ",\n".join(out) + "\n" + last.replace("{n}", str(len(steps)))


FIXTURES = {"emb8": (fixtures.emb8, 1), "emb4": (fixtures.emb4, 4), "part_rgb": (fixtures.part_rgb, 3)}


def _on(name: str, source: str, op, *steps: str) -> None:
    make = FIXTURES[source][0]
    _add(name, lambda spark, sf: R.samples(op(make(spark, sf))), _ctes(source, list(steps)))


# SQL of one step each, from samples with image_id, width, height, y, x, c, v.
FLIP = "SELECT * REPLACE (height - 1 - y AS y) FROM {s}"
FLOP = "SELECT * REPLACE (width - 1 - x AS x) FROM {s}"
ROT90 = "SELECT image_id, height AS width, width AS height, x AS y, height - 1 - y AS x, c, v FROM {s}"
ROT180 = "SELECT * REPLACE (height - 1 - y AS y, width - 1 - x AS x) FROM {s}"
ROT270 = "SELECT image_id, height AS width, width AS height, width - 1 - x AS y, y AS x, c, v FROM {s}"


def crop_sql(x, y, w, h):
    return f"SELECT image_id, {w} AS width, {h} AS height, y - {y} AS y, x - {x} AS x, c, v FROM {{s}} WHERE x BETWEEN {x} AND {x + w - 1} AND y BETWEEN {y} AND {y + h - 1}"


def flatten_sql(r, g, b):
    return f"""SELECT f.image_id, f.width, f.height, f.y, f.x, f.c, (f.v * a.v + (CASE f.c WHEN 0 THEN {r} WHEN 1 THEN {g} ELSE {b} END) * (255 - a.v) + 127) // 255 AS v
  FROM {{s}} f JOIN {{s}} a ON a.image_id = f.image_id AND a.y = f.y AND a.x = f.x AND a.c = 3 WHERE f.c < 3"""


def convolve_sql(k: Kernel):
    ry, rx = k.height // 2, k.width // 2
    taps = ", ".join(f"({y - ry}, {x - rx}, {int(k.fixed[y, x])})" for y in range(k.height) for x in range(k.width))
    return f"""SELECT o.image_id, o.width, o.height, o.y, o.x, o.c, GREATEST(0, LEAST(255, CAST(SUM(i.v * CAST(k.q AS BIGINT)) + 8192 AS BIGINT) >> 14)) AS v
  FROM {{s}} o CROSS JOIN (VALUES {taps}) k(dy, dx, q) JOIN {{s}} i ON i.image_id = o.image_id AND i.c = o.c
    AND i.y = GREATEST(0, LEAST(o.height - 1, o.y + k.dy)) AND i.x = GREATEST(0, LEAST(o.width - 1, o.x + k.dx)) GROUP BY ALL"""


def resample_sql(axis: str, size: str, sizes: list[int], out: int, name: str):
    rows = ", ".join(f"({s}, {o}, {i}, {q})" for s in sizes for o, i, q, _ in weights(name, s, out).rows())
    kept = {"x": f"image_id, {out} AS width, height, y, w.o AS x", "y": f"image_id, width, {out} AS height, w.o AS y, x"}[axis]
    keys = {"x": "image_id, height, y, w.o, c", "y": "image_id, width, w.o, x, c"}[axis]
    return f"""SELECT {kept}, c, GREATEST(0, LEAST(255, CAST(SUM(v * CAST(w.q AS BIGINT)) + 8192 AS BIGINT) >> 14)) AS v
  FROM {{s}} JOIN (VALUES {rows}) w(s, o, i, q) ON {size} = w.s AND {axis} = w.i GROUP BY {keys}"""


def resize_sql(widths, heights, w, h, name):
    return resample_sql("x", "width", widths, w, name), resample_sql("y", "height", heights, h, name)


def modulate_sql(b: float, s: float, h: float) -> str:
    f = lambda e: f"CAST({e} AS FLOAT)"
    clamp = lambda e: f"GREATEST({f(0)}, LEAST({f(1)}, {e}))"
    hue = f"CASE WHEN d <= {f(2.0 ** -23)} THEN {f(0)} WHEN t = r THEN {f(60)} * {f(f'{f("(g - b) / d")} % {f(6)}')} WHEN t = g THEN {f(60)} * {f(f'{f("(b - r) / d")} + {f(2)}')} ELSE {f(60)} * {f(f'{f("(r - g) / d")} + {f(4)}')} END"
    store = lambda e: f"CAST(FLOOR({f(f'{f(f'{clamp(e)} * {f(255)}')} + {f(0.5)}')}) AS INT)"
    return f"""SELECT image_id, width, height, y, x, k.c, CASE k.c WHEN 0 THEN {store('rr + m')} WHEN 1 THEN {store('gg + m')} WHEN 2 THEN {store('bb + m')} ELSE a END AS v FROM (
  SELECT *, CASE n WHEN 0 THEN cc WHEN 1 THEN xx WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN xx ELSE cc END rr, CASE n WHEN 0 THEN xx WHEN 1 THEN cc WHEN 2 THEN cc WHEN 3 THEN xx ELSE 0 END gg,
    CASE n WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN xx WHEN 3 THEN cc WHEN 4 THEN cc ELSE xx END bb FROM (
  SELECT *, {f(f'val - cc')} m, LEAST(5, CAST(FLOOR(k6) AS INT)) n, {f(f'cc * {f(f"{f(1)} - ABS({f(f'{f(f"k6 % {f(2)}")} - {f(1)}')})")}')} xx FROM (
  SELECT *, {f(f'val * sat')} cc, {f(f'h2 / {f(60)}')} k6 FROM (
  SELECT *, CASE WHEN h1 < 0 THEN {f(f'h1 + {f(360)}')} ELSE h1 END h2, {clamp(f(f's0 * {f(s)}'))} sat, {clamp(f(f't * {f(b)}'))} val FROM (
  SELECT *, {f(f'{f(f'({hue}) + {f(h)}')} % {f(360)}')} h1, CASE WHEN t <= {f(2.0 ** -23)} THEN {f(0)} ELSE {f('d / t')} END s0 FROM (
  SELECT *, GREATEST(r, g, b) t, {f('GREATEST(r, g, b) - LEAST(r, g, b)')} d FROM (
  SELECT image_id, width, height, y, x, {', '.join(f"{f(f'{f(f'MAX(CASE c WHEN {i} THEN v END)')} / {f(255)}')} {n}" for i, n in enumerate('rgb'))}, MAX(CASE c WHEN 3 THEN v END) a FROM {{s}} GROUP BY ALL)))))))
  CROSS JOIN (VALUES (0), (1), (2), (3)) k(c)"""


def composite_sql(dx: int, dy: int, blend: str) -> str:
    """The overlay is the image turned by 180 degrees, moved by (dx, dy)."""
    over = f"(SELECT image_id, height - 1 - y + {dy} AS y, width - 1 - x + {dx} AS x, c, v FROM {{s}})"
    if blend == "source":
        return f"SELECT b.image_id, b.width, b.height, b.y, b.x, b.c, COALESCE(o.v, b.v) AS v FROM {{s}} b LEFT JOIN {over} o USING (image_id, y, x, c)"
    return f"""SELECT b.image_id, b.width, b.height, b.y, b.x, b.c, CASE WHEN o.v IS NULL THEN b.v WHEN t.t = 0 THEN 0 WHEN b.c = 3 THEN LEAST(255, (t.t + 127) // 255)
    ELSE LEAST(255, (o.v * t.sa * 255 + b.v * t.rest + t.t // 2) // t.t) END AS v FROM {{s}} b LEFT JOIN {over} o USING (image_id, y, x, c)
  LEFT JOIN (SELECT p.image_id, p.y, p.x, q.v sa, p.v * (255 - q.v) rest, q.v * 255 + p.v * (255 - q.v) t FROM {{s}} p JOIN {over} q USING (image_id, y, x, c) WHERE p.c = 3) t
  ON t.image_id = b.image_id AND t.y = b.y AND t.x = b.x"""


for _name in ("emb8", "emb4", "part_rgb"):
    _on(f"source_{_name}", _name, lambda d: d)
_on("crop", "emb8", lambda d: R.crop(d, 2, 1, 5, 6), crop_sql(2, 1, 5, 6))
_on("flip", "part_rgb", R.flip, FLIP)
_on("flop", "part_rgb", R.flop, FLOP)
for _degrees, _sql in ((90, ROT90), (180, ROT180), (270, ROT270)):
    _on(f"rotate_{_degrees}", "part_rgb", lambda d, _degrees=_degrees: R.rotate(d, _degrees), _sql)
_on("rotate_minus_90", "part_rgb", lambda d: R.rotate(d, -90), ROT270)
_on("extract_channel", "emb4", lambda d: R.extract_channel(d, 2, 4), "SELECT * REPLACE (0 AS c) FROM {s} WHERE c = 2")
_on("flatten", "emb4", lambda d: R.flatten(d, (10, 200, 90), 4), flatten_sql(10, 200, 90))
_on("modulate", "emb4", lambda d: R.modulate(d, kernels.Modulate(1.25, 0.75, 40.0), 4), modulate_sql(1.25, 0.75, 40.0))
_on("modulate_hue_back", "emb4", lambda d: R.modulate(d, kernels.Modulate(0.5, 2.0, -200.0), 4), modulate_sql(0.5, 2.0, -200.0))
KERNELS = {"box_3": Kernel.box(3), "gaussian": Kernel.gaussian(0.8), "sharpen": Kernel.sharpen(0.5), "wide": Kernel(5, 1, (1.0, 2.0, 3.0, 2.0, 1.0)), "edges": Kernel(3, 3, (-1.0, -1.0, -1.0, -1.0, 8.0, -1.0, -1.0, -1.0, -1.0))}
for _name, _kernel in KERNELS.items():
    _on(f"convolve_{_name}", "emb8", lambda d, _kernel=_kernel: R.convolve(d, _kernel, 1), convolve_sql(_kernel))
_on("blur_mixed_sizes", "part_rgb", lambda d: R.convolve(d, Kernel.box(3), 3), convolve_sql(Kernel.box(3)))
for _name in FILTERS:
    _on(f"resize_{_name.replace('-', '_')}", "emb8", lambda d, _name=_name: R.resize(d, 5, 3, _name, 1, ([8], [8])), *resize_sql([8], [8], 5, 3, _name))
_on("enlarge", "emb8", lambda d: R.resize(d, 13, 11, "lanczos3", 1, ([8], [8])), *resize_sql([8], [8], 13, 11, "lanczos3"))
_on("thumbnail", "emb8", lambda d: R.resize(d, 4, 4, "lanczos3", 1, ([8], [8])), *resize_sql([8], [8], 4, 4, "lanczos3"))
MIXED = (list(range(1, 51)), list(range(1, 17)))  # p_size is 1 to 50
_on("resize_mixed_sizes", "part_rgb", lambda d: R.resize(d, 12, 9, "bilinear", 3, MIXED), *resize_sql(*MIXED, 12, 9, "bilinear"))
_on("composite_over", "emb4", lambda d: R.composite(d, R.rotate(d, 180), 1, -1, "over", 4), composite_sql(1, -1, "over"))
_on("composite_source", "emb4", lambda d: R.composite(d, R.rotate(d, 180), -2, 1, "source", 4), composite_sql(-2, 1, "source"))
_on("composite_outside", "emb4", lambda d: R.composite(d, R.rotate(d, 180), 9, 9, "over", 4), composite_sql(9, 9, "over"))
_on("saturating_sum", "emb8", lambda d: R.saturating_sum(d, R.flip(d), 1), "SELECT a.* REPLACE (LEAST(255, a.v + b.v) AS v) FROM {s} a JOIN {s} b ON a.image_id = b.image_id AND a.x = b.x AND a.y = b.height - 1 - b.y AND a.c = b.c".replace("a.y = b.height - 1 - b.y", "a.height - 1 - a.y = b.y"))

# chains, relational and as arrays
_on("chain_relational", "emb8", lambda d: R.rotate(R.convolve(R.resize(d, 6, 4, "mitchell", 1, ([8], [8])), Kernel.box(3), 1), 90), *resize_sql([8], [8], 6, 4, "mitchell"), convolve_sql(Kernel.box(3)), ROT90)


def _images(spark: SparkSession, sf: str, source: str) -> Raster:
    make, channels = FIXTURES[source]
    return Raster(tiles.from_samples(make(spark, sf), {1: "gray8", 3: "rgb8", 4: "rgba8"}[channels]))


def _arrays(name: str, source: str, op, *steps: str) -> None:
    _add(name, lambda spark, sf: op(_images(spark, sf, source)).samples(), _ctes(source, list(steps)))


_arrays("chain_arrays", "emb8", lambda r: r.resize(6, 4, "mitchell").convolve(Kernel.box(3)).rotate(90), *resize_sql([8], [8], 6, 4, "mitchell"), convolve_sql(Kernel.box(3)), ROT90)
_arrays("arrays_mixed_sizes", "part_rgb", lambda r: r.resize(12, 9, "bilinear").sharpen(0.5).flop(), *resize_sql(*MIXED, 12, 9, "bilinear"), convolve_sql(Kernel.sharpen(0.5)), FLOP)
_arrays("arrays_flatten_modulate", "emb4", lambda r: r.modulate(1.25, 0.75, 40.0).flatten(10, 200, 90).crop(1, 1, 3, 2), modulate_sql(1.25, 0.75, 40.0), flatten_sql(10, 200, 90), crop_sql(1, 1, 3, 2))
_arrays("arrays_thumbnail", "emb8", lambda r: r.thumbnail(4, 6), *resize_sql([8], [8], 4, 4, "lanczos3"))
_add(
    "metadata", lambda spark, sf: replace(_images(spark, sf, "part_rgb"), headers=fixtures.part_sizes(spark, sf).withColumn("pixel", F.lit("rgb8"))).flip().metadata(),
    "SELECT p_partkey AS image_id, p_size AS width, CAST(1 + p_partkey % 16 AS INT) AS height, 'rgb8' AS pixel FROM part",
)

# colour, chroma, palettes
_PIVOT = "SELECT image_id, width, height, y, x, MAX(v) FILTER (c = 0) r, MAX(v) FILTER (c = 1) g, MAX(v) FILTER (c = 2) b FROM {s} GROUP BY ALL"


def _matrix_sql(rows: list[str]) -> str:
    pick = " ".join(f"WHEN {k} THEN {e}" for k, e in enumerate(rows))
    return f"SELECT image_id, width, height, y, x, k.c, GREATEST(0, LEAST(255, CASE k.c {pick} END)) AS v FROM ({_PIVOT}) CROSS JOIN (VALUES (0), (1), (2)) k(c)"


TO_YCBCR_SQL = _matrix_sql([f"((({a} * r + {b} * g + {c} * b + 32768) >> 16) + {d})" for a, b, c, d in color.TO_YCBCR])
TO_RGB_SQL = _matrix_sql([f"((65536 * r + {a} * (g - 128) + {b} * (b - 128) + 32768) >> 16)" for a, b in color.TO_RGB])
_on("to_ycbcr", "part_rgb", color.to_ycbcr, TO_YCBCR_SQL)
_on("ycbcr_round_trip", "part_rgb", lambda d: color.to_rgb(color.to_ycbcr(d)), TO_YCBCR_SQL, TO_RGB_SQL)
_on(
    "chroma_shrink", "part_rgb", lambda d: color.box_shrink(d, 2, 2, 3),
    """SELECT o.image_id, (o.width + 1) // 2 AS width, (o.height + 1) // 2 AS height, o.cy AS y, o.cx AS x, o.c, (SUM(i.v) + 2) // 4 AS v
  FROM (SELECT image_id, width, height, y // 2 cy, x // 2 cx, c FROM {s} WHERE y % 2 = 0 AND x % 2 = 0) o CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dy, dx)
  JOIN {s} i ON i.image_id = o.image_id AND i.c = o.c AND i.y = LEAST(o.height - 1, o.cy * 2 + d.dy) AND i.x = LEAST(o.width - 1, o.cx * 2 + d.dx) GROUP BY ALL""",
)
_on("chroma_repeat", "emb8", lambda d: color.box_repeat(d, 2, 2), "SELECT image_id, 16 AS width, 16 AS height, y * 2 + dy AS y, x * 2 + dx AS x, c, v FROM {s} CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dy, dx)")
_on("predict_rows", "part_rgb", lambda d: color.difference_rows(d, 3), "SELECT * REPLACE ((v - COALESCE(LAG(v) OVER (PARTITION BY image_id, y, c ORDER BY x), 0) + 256) % 256 AS v) FROM {s}")
_on("predict_columns", "part_rgb", lambda d: color.difference_columns(d, 3), "SELECT * REPLACE ((v - COALESCE(LAG(v) OVER (PARTITION BY image_id, x, c ORDER BY y), 0) + 256) % 256 AS v) FROM {s}")
_on("sum_rows", "part_rgb", lambda d: color.sum_rows(d, 3), "SELECT * REPLACE (SUM(v) OVER (PARTITION BY image_id, y, c ORDER BY x) % 256 AS v) FROM {s}")
_on("predict_round_trip", "part_rgb", lambda d: color.sum_rows(color.difference_rows(d, 3), 3))
ORACLES["predict_round_trip"] = ORACLES["source_part_rgb"]
_add("histogram", lambda spark, sf: color.histogram(fixtures.part_rgb(spark, sf)), _ctes("part_rgb", [_PIVOT], "SELECT image_id, r, g, b, COUNT(*) AS n FROM s1 GROUP BY ALL"))
PALETTE = [(0, 0, 0), (255, 255, 255), (200, 30, 30), (30, 200, 30), (30, 30, 200), (128, 128, 128), (0, 0, 0)]
_add(
    "nearest_entry", lambda spark, sf: color.nearest_entry(fixtures.part_rgb(spark, sf), PALETTE),
    _ctes("part_rgb", [_PIVOT], f"SELECT image_id, y, x, arg_min(i, ((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)) * 256 + i) AS idx FROM s1 CROSS JOIN (VALUES {', '.join(f'({i}, {r}, {g}, {b})' for i, (r, g, b) in enumerate(PALETTE))}) p(i, pr, pg, pb) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY image_id, y, x")),
)
_add(
    "interlace_pass", lambda spark, sf: color.interlace_pass(fixtures.emb8(spark, sf)),
    _ctes("emb8", [], "SELECT image_id, y, x, p AS pass FROM s0 JOIN (VALUES (1, 0, 8, 0, 8), (2, 0, 8, 4, 8), (3, 4, 8, 0, 4), (4, 0, 4, 2, 4), (5, 2, 4, 0, 2), (6, 0, 2, 1, 2), (7, 1, 2, 0, 1)) t(p, y0, dy, x0, dx) ON y >= y0 AND (y - y0) % dy = 0 AND x >= x0 AND (x - x0) % dx = 0"),
)
_add(
    "quality_steps", lambda spark, sf: fixtures.emb8(spark, sf).select("image_id", "y", "x", *(color.quality_step(F.col("px")[0], q).alias(f"q{q}") for q in (10, 50, 90))),
    _ctes("emb8", [], "SELECT image_id, y, x, " + ", ".join(f"GREATEST(1, LEAST(255, (v * {5000 // q if q < 50 else 200 - 2 * q} + 50) // 100)) AS q{q}" for q in (10, 50, 90)) + " FROM s0"),
)

# what file formats are made of
_on("bit_unpack", "emb8", lambda d: color.bit_unpack(d, 2), "SELECT image_id, 32 AS width, height, y, x * 4 + k AS x, c, (((v >> (6 - 2 * k)) & 3) * 255 + 1) // 3 AS v FROM {s} CROSS JOIN (VALUES (0), (1), (2), (3)) t(k)")
_on(
    "palette_expand", "emb8", lambda d: color.palette_expand(d.withColumn("px", F.array(F.col("px")[0] % len(PALETTE))), PALETTE, [0, 77, 200]),
    f"SELECT image_id, width, height, y, x, k.c, CASE k.c WHEN 0 THEN p.r WHEN 1 THEN p.g WHEN 2 THEN p.b ELSE COALESCE(t.a, 255) END AS v FROM {{s}} s CROSS JOIN (VALUES (0), (1), (2), (3)) k(c) JOIN (VALUES {', '.join(f'({i}, {r}, {g}, {b})' for i, (r, g, b) in enumerate(PALETTE))}) p(i, r, g, b) ON p.i = s.v % {len(PALETTE)} LEFT JOIN (VALUES (0, 0), (1, 77), (2, 200)) t(i, a) ON t.i = p.i",
)
_add(
    "png_filter_choice", lambda spark, sf: color.filter_choice(fixtures.emb8(spark, sf)),
    _ctes("emb8", [], """, n AS (SELECT image_id, y, x, v, COALESCE(LAG(v) OVER (PARTITION BY image_id, y ORDER BY x), 0) a, COALESCE(LAG(v) OVER (PARTITION BY image_id, x ORDER BY y), 0) b FROM s0),
m AS (SELECT *, COALESCE(LAG(b) OVER (PARTITION BY image_id, y ORDER BY x), 0) c FROM n),
g AS (SELECT image_id, y, k, (v - CASE k WHEN 0 THEN 0 WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN (a + b) // 2 ELSE CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END END + 256) % 256 AS d FROM m CROSS JOIN (VALUES (0), (1), (2), (3), (4)) f(k)),
h AS (SELECT image_id, y, k, SUM(CASE WHEN d > 127 THEN 256 - d ELSE d END) AS s FROM g GROUP BY image_id, y, k)
SELECT image_id, y, arg_min(k, s * 8 + k) AS filter FROM h GROUP BY image_id, y""").replace("\n, n AS", ", n AS"),
)
_add(
    "tile_grid", lambda spark, sf: color.tile_grid(fixtures.part_sizes(spark, sf), 16, 4, 10, 3, 25, 9),
    """SELECT image_id, CAST(r * ((width + 15) // 16) + c AS INT) AS chunk, CAST(c * 16 AS INT) AS x, CAST(r * 4 AS INT) AS y
  FROM (SELECT p_partkey image_id, p_size width, CAST(1 + p_partkey % 16 AS INT) height FROM part) CROSS JOIN (SELECT UNNEST(RANGE(0, 4)) r) CROSS JOIN (SELECT UNNEST(RANGE(0, 4)) c)
  WHERE c * 16 < width AND r * 4 < height AND c * 16 < 35 AND c * 16 + 16 > 10 AND r * 4 < 12 AND r * 4 + 4 > 3 AND width > 10 AND height > 3""",
)


def _round_trip(name: str, source: str, write, sql: str | None = None) -> None:
    """Every image written as a file and read again; write: (array, image_id) -> bytes."""

    def step(batches):
        for b in batches:
            rows = []
            for i, *x in zip(*(b.column(k).to_pylist() for k in range(5))):
                d = Descriptor(*x[:3])
                data = write(tiles.decode_row(*x), i)
                out = raw.decode(data, d, d.row_bytes + 3) if name == "raw_round_trip" else codecs.decode(data)
                rows.append((i, out.shape[1], out.shape[0], descriptor_of(out).pixel, np.ascontiguousarray(out).tobytes()))
            yield tiles.batch_of(rows)

    _add(name, lambda spark, sf: tiles.to_samples(_images(spark, sf, source).images().mapInArrow(step, tiles.IMAGE)), sql or ORACLES[f"source_{source}"])


_round_trip("png_round_trip", "part_rgb", lambda a, i: png.encode(a))
_round_trip("png_unfilter", "emb4", lambda a, i: png.encode(a, filters=[(i + y) % 5 for y in range(len(a))]))
_round_trip("tiff_round_trip", "part_rgb", lambda a, i: tiff.encode(a, tile=16 if i % 2 else None, compression=(tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS)[i % 4], predictor=1 + i // 4 % 2, order="<>"[i // 8 % 2]))
_round_trip("gif_round_trip", "emb8", lambda a, i: gif.encode(a, EncodeOptions(100)), _ctes("emb8", ["SELECT s.image_id, width, height, y, x, k.c, CASE k.c WHEN 3 THEN 255 ELSE v END AS v FROM {s} s CROSS JOIN (VALUES (0), (1), (2), (3)) k(c)"]))
_round_trip("raw_round_trip", "emb4", lambda a, i: raw.encode(a, stride=a[0].nbytes + 3))

# animations
_add("frames", fixtures.event_frames, fixtures.SQL["event_frames"])
_add("frames_last_drawn", lambda spark, sf: frames.last_drawn(fixtures.event_frames(spark, sf)), f"SELECT image_id, y, x, arg_max(idx, frame_no) AS idx FROM ({fixtures.SQL['event_frames']}) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY image_id, y, x"))
_CANVAS = f"""WITH f AS (SELECT *, MAX(frame_no) OVER (PARTITION BY image_id) AS last FROM ({fixtures.SQL['event_frames']})),
g AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, y, x ORDER BY frame_no DESC) AS n FROM f WHERE disposal <> 3 OR frame_no = last)
SELECT image_id, y, x, idx FROM g WHERE n = 1 AND (disposal <> 2 OR frame_no = last)"""
_add("canvas_streamed", lambda spark, sf: frames.final_canvas(fixtures.event_frames(spark, sf)), _CANVAS)
_add("canvas_by_windows", lambda spark, sf: frames.canvas_by_windows(fixtures.event_frames(spark, sf)), _CANVAS)

# The first bytes of files, and the formats they show.
# sniffing: every document stands for a file that starts with one of these
HEADS = ("89504e470d0a1a0a0000", "474946383961", "474946383761ff", "ffd8ffe0", "49492a0008", "4d4d002a", "524946460000000057454250", "000000186674797061766966000000006d696631", "000000186674797078787878000000006d696631", "0000", "")
NAMES = ("png", "gif", "gif", "jpeg", "tiff", "tiff", "webp", "avif", "avif", None, None)
_add(
    "sniff", lambda spark, sf: fixtures._table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"), sniff.sniff(F.element_at(F.array(*(F.unhex(F.lit(h)) for h in HEADS)), (F.col("doc_id") % len(HEADS) + 1).cast("int"))).alias("format")),
    f"SELECT doc_id AS image_id, CASE doc_id % {len(HEADS)} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(NAMES) if n) + " END AS format FROM documents",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resize by Lanczos, blur and turn: the longest relational chain."""
    return QUERIES["chain_relational"](spark, sf_dir)
