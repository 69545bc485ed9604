"""TIFF: strips and tiles, both byte orders, none, LZW, Deflate and PackBits,
horizontal prediction, gray of 1 to 16 bits, gray with alpha, RGB(A), palettes.

A file is a grid of chunks (strips are tiles as wide as the image). Only the
chunks that a wanted region touches are unpacked.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from tessella.codecs.bits import deflate, inflate, lzw_decode, lzw_encode, malformed, packbits_decode, packbits_encode, stretch, unpack, unsupported
from tessella.functions.types import EncodeOptions, Limits, Region, invalid

# Tags; sizes of field types; compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, COLORS, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, EXTRA = 317, 320, 322, 323, 324, 325, 338
KINDS = {1: "B", 3: "H", 4: "I"}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


def tags(data: bytes) -> tuple[str, dict[int, tuple[int, ...]]]:
    """The byte order and the whole-number fields of the first directory."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None or len(data) < 8:
        raise malformed("not a TIFF header")
    at = struct.unpack_from(order + "I", data, 4)[0]
    if at + 2 > len(data):
        raise malformed("the directory is outside the file")
    n = struct.unpack_from(order + "H", data, at)[0]
    if at + 2 + 12 * n > len(data):
        raise malformed("the directory is cut off")
    found = {}
    for k in range(n):
        place = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(order + "HHI", data, place)
        if kind not in KINDS:
            continue
        size = struct.calcsize(KINDS[kind]) * count
        where = place + 8 if size <= 4 else struct.unpack_from(order + "I", data, place + 8)[0]
        if where + size > len(data):
            raise malformed(f"field {tag} is outside the file")
        found[tag] = struct.unpack_from(f"{order}{count}{KINDS[kind]}", data, where)
    return order, found


def chunks_covering(region: Region, width: int, height: int, tile_width: int, tile_height: int) -> list[tuple[int, Region]]:
    """Number and place of the chunks of a grid that a region touches."""
    across = -(-width // tile_width)
    rows = range(region.y // tile_height, -(-region.bottom // tile_height))
    columns = range(region.x // tile_width, -(-region.right // tile_width))
    return [(r * across + c, Region(c * tile_width, r * tile_height, tile_width, tile_height)) for r in rows for c in columns]


@dataclass
class Layout:
    order: str
    width: int
    height: int
    bits: int
    samples: int
    photometric: int
    compression: int
    predictor: int
    tile: tuple[int, int]
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    colors: tuple[int, ...]
    alpha: bool
    strips: bool


def layout(data: bytes, limits: Limits = Limits()) -> Layout:
    order, found = tags(data)
    one = lambda tag, usual=None: found[tag][0] if found.get(tag) else usual
    width, height = one(WIDTH, 0), one(HEIGHT, 0)
    if not width or not height:
        raise malformed("no size")
    limits.check(width, height)
    samples, bits = one(SAMPLES, 1), set(found.get(BITS, (1,)))
    kind = one(PHOTOMETRIC, 1)
    if len(bits) != 1 or one(PLANAR, 1) != 1 or kind not in (0, 1, 2, 3) or not 1 <= samples <= 4:
        raise unsupported(f"samples {samples} of {sorted(bits)} bits, photometric {kind}, planar {one(PLANAR, 1)}")
    depth = bits.pop()
    legal = {0: (1, 2, 4, 8, 16), 1: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8)}[kind]
    if depth not in legal or (kind == 2) != (samples > 2) or (samples == 2 and depth < 8) or (kind == 3 and samples != 1):
        raise unsupported(f"{samples} samples of {depth} bits, photometric {kind}")
    tiled = TILE_OFFSETS in found
    tile = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(height, one(ROWS, height)))
    offsets, counts = found.get(TILE_OFFSETS if tiled else OFFSETS, ()), found.get(TILE_COUNTS if tiled else COUNTS, ())
    if min(tile) <= 0:
        raise malformed("chunks without a size")
    need = -(-width // tile[0]) * -(-height // tile[1])
    if len(offsets) < need or len(counts) < need:
        raise malformed(f"{len(offsets)} chunks of {need}")
    return Layout(order, width, height, depth, samples, kind, one(COMPRESSION, 1), one(PREDICTOR, 1), tile, offsets, counts, found.get(COLORS, ()), samples in (2, 4), not tiled)


def size_of(data: bytes) -> tuple[int, int]:
    _, found = tags(data)
    return found.get(WIDTH, (0,))[0], found.get(HEIGHT, (0,))[0]


def _chunk(data: bytes, f: Layout, k: int, width: int, height: int) -> np.ndarray:
    row_bytes = (width * f.samples * f.bits + 7) // 8
    size = row_bytes * height
    body = data[f.offsets[k] : f.offsets[k] + f.counts[k]]
    if len(body) < f.counts[k]:
        raise malformed(f"chunk {k} is outside the file")
    if f.compression == LZW:
        body = lzw_decode(body, 8, size, high_first=True)
    elif f.compression in (DEFLATE, OLD_DEFLATE):
        body = inflate(body, size)
    elif f.compression == PACKBITS:
        body = packbits_decode(body, size)
    elif f.compression != NONE:
        raise unsupported(f"compression {f.compression}")
    if len(body) < size:
        raise malformed(f"chunk {k} has {len(body)} bytes of {size}")
    rows = np.frombuffer(body[:size], np.uint8).reshape(height, row_bytes)
    if f.bits == 16:
        a = np.ascontiguousarray(rows).view(f.order + "u2").astype(np.uint16)
    else:
        a = unpack(rows, f.bits, width * f.samples)
    a = a.reshape(height, width, f.samples)
    if f.predictor == 2:
        if f.bits < 8:
            raise unsupported("prediction of samples below 8 bits")
        a = np.cumsum(a, axis=1, dtype=a.dtype)
    elif f.predictor != 1:
        raise unsupported(f"predictor {f.predictor}")
    return a


def decode(data: bytes, limits: Limits = Limits(), region: Region | None = None) -> np.ndarray:
    f = layout(data, limits)
    whole = Region(0, 0, f.width, f.height)
    region = region or whole
    if not whole.contains(region):
        raise invalid(f"{region} is outside {whole}")
    out = np.zeros((region.height, region.width, f.samples), np.uint16 if f.bits == 16 else np.uint8)
    for k, place in chunks_covering(region, f.width, f.height, *f.tile):
        rows = min(place.height, f.height - place.y) if f.strips else place.height
        a = _chunk(data, f, k, place.width, rows)
        part = place.intersect(region)
        part = part.intersect(whole) if part else None
        if part:
            out[part.y - region.y : part.bottom - region.y, part.x - region.x : part.right - region.x] = a[part.y - place.y : part.bottom - place.y, part.x - place.x : part.right - place.x]
    if f.photometric == 3:
        table = np.array(f.colors, np.uint32)
        if len(table) < 3 << f.bits:
            raise malformed("the colour map is too short")
        return (table.reshape(3, -1)[:, out[..., 0]] >> 8).astype(np.uint8).transpose(1, 2, 0)
    if f.photometric == 0:
        top = (1 << f.bits) - 1
        out[..., 0] = top - out[..., 0]
    if f.bits < 8:
        out = stretch(out, f.bits)
    return out[..., [0, 0, 0, 1]] if f.bits == 16 and f.samples == 2 else out


def encode(a: np.ndarray, options: EncodeOptions = EncodeOptions(), tile: int | None = None, compression: int | None = None, predictor: int = 1, order: str = "<") -> bytes:
    """Strips of 64 rows, or tiles whose side is a multiple of 16. Deflate from
    quality 51 on, if no compression is named."""
    if a.dtype.kind == "f":
        raise unsupported("TIFF files here have whole-number samples")
    if tile is not None and (tile <= 0 or tile % 16):
        raise invalid(f"tiles of {tile}: a side is a multiple of 16")
    h, w, n = a.shape
    if compression is None:
        compression = DEFLATE if options.quality > 50 else NONE
    level = min(9, max(1, (options.quality - 50) * 9 // 50))
    tw, th = (tile, tile) if tile else (w, min(64, h))
    bodies = []
    for _, place in chunks_covering(Region(0, 0, w, h), w, h, tw, th):
        part = a[place.y : place.y + th, place.x : place.x + tw]
        if tile:
            part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
        if predictor == 2:
            part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
        body = part.astype(f"{order}u{a.dtype.itemsize}").tobytes()
        bodies.append({NONE: lambda b: b, DEFLATE: lambda b: deflate(b, level), PACKBITS: packbits_encode, LZW: lambda b: lzw_encode(b, 8, high_first=True)}[compression](body))
    offsets, at = [], 8
    for b in bodies:
        offsets.append(at)
        at += len(b) + len(b) % 2
    counts = [len(b) for b in bodies]
    fields = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [a.dtype.itemsize * 8] * n), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if n > 2 else 1]), (SAMPLES, 3, [n]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
    fields += [(TILE_WIDTH, 4, [tw]), (TILE_HEIGHT, 4, [th]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(OFFSETS, 4, offsets), (ROWS, 4, [th]), (COUNTS, 4, counts)]
    if n in (2, 4):
        fields.append((EXTRA, 3, [2]))
    entries, more = b"", b""
    behind = at + 2 + 12 * len(fields) + 4
    for tag, kind, values in sorted(fields):
        packed = struct.pack(f"{order}{len(values)}{KINDS[kind]}", *values)
        if len(packed) > 4:
            place = struct.pack(order + "I", behind + len(more))
            more += packed + bytes(len(packed) % 2)
        else:
            place = packed.ljust(4, b"\0")
        entries += struct.pack(order + "HHI", tag, kind, len(values)) + place
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at)
    return head + b"".join(b + bytes(len(b) % 2) for b in bodies) + struct.pack(order + "H", len(fields)) + entries + bytes(4) + more
