"""PNG: all legal depths and colour types, palettes, transparency, Adam7.

Filters that only look up or left are sums over whole arrays; Average and Paeth
depend on what they have just made, so they go sample by sample.
"""

from __future__ import annotations

import struct

import numpy as np

from tessella.codecs.bits import crc32, deflate, inflate, malformed, stretch, unpack, unsupported
from tessella.functions.types import EncodeOptions, Limits, RasterError, invalid

# Signature; channels and legal depths of each colour type; Adam7 passes as x, y, step of x, step of y.
SIGNATURE = bytes.fromhex("89504e470d0a1a0a")
TYPES = {0: (1, (1, 2, 4, 8, 16)), 2: (3, (8, 16)), 3: (1, (1, 2, 4, 8)), 4: (2, (8, 16)), 6: (4, (8, 16))}
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
FILTERS = ("none", "sub", "up", "average", "paeth")


def chunks(data: bytes):
    """(name, body) of every chunk up to IEND, checksums verified."""
    if data[:8] != SIGNATURE:
        raise malformed("not a PNG signature")
    at = 8
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or len(data) < at + 12 + size:
            raise malformed(f"chunk {name!r} is cut off")
        if crc32(name + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise malformed(f"checksum of chunk {name!r}")
        yield name, body
        at += 12 + size
        if name == b"IEND":
            return
    raise malformed("no IEND")


def header(body: bytes, limits: Limits = Limits()) -> tuple[int, int, int, int, int]:
    """width, height, depth, colour type, interlace of a legal IHDR."""
    if len(body) != 13:
        raise malformed(f"IHDR of {len(body)} bytes")
    width, height, depth, kind, method, filters, interlace = struct.unpack(">IIBBBBB", body)
    if kind not in TYPES or depth not in TYPES[kind][1] or method or filters or interlace > 1 or not width or not height:
        raise malformed(f"IHDR {width}x{height}, depth {depth}, type {kind}, methods {method} {filters} {interlace}")
    limits.check(width, height)
    return width, height, depth, kind, interlace


def size_of(data: bytes) -> tuple[int, int]:
    name, body = next(chunks(data))
    if name != b"IHDR":
        raise malformed("IHDR does not come first")
    return header(body)[:2]


def paeth(a, b, c):
    """Of left, above and above left, the one nearest to a + b - c; ties go in that order."""
    a, b, c = (np.asarray(v, np.int16) for v in (a, b, c))
    pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def unfilter(data: bytes, rows: int, row_bytes: int, step: int) -> np.ndarray:
    """Rows of bytes without their filters; step: bytes of a whole cell."""
    lines = np.frombuffer(data, np.uint8)
    if len(lines) < rows * (row_bytes + 1):
        raise malformed("too few bytes of samples")
    lines = lines[: rows * (row_bytes + 1)].reshape(rows, row_bytes + 1)
    out, above = np.empty((rows, row_bytes), np.uint8), np.zeros(row_bytes, np.uint8)
    for y in range(rows):
        kind, line = int(lines[y, 0]), lines[y, 1:]
        if kind == 0:
            out[y] = line
        elif kind == 1:
            whole = np.zeros(-(-row_bytes // step) * step, np.uint8)
            whole[:row_bytes] = line
            out[y] = np.cumsum(whole.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:row_bytes]
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            made, up, got = [0] * step + [0] * row_bytes, [0] * step + above.tolist(), line.tolist()
            for k, v in enumerate(got):
                a, b = made[k], up[k + step]
                if kind == 3:
                    guess = a + b >> 1
                else:
                    c = up[k]
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                made[k + step] = v + guess & 255
            out[y] = made[step:]
        else:
            raise malformed(f"filter {kind}")
        above = out[y]
    return out


def filtered(rows: np.ndarray, step: int) -> np.ndarray:
    """(filters, rows, bytes): the rows under each of the five filters."""
    left, up = np.zeros_like(rows), np.zeros_like(rows)
    left[:, step:], up[1:] = rows[:, :-step] if rows.shape[1] > step else rows[:, :0], rows[:-1]
    corner = np.zeros_like(rows)
    corner[1:] = left[:-1]
    mean = ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
    return np.stack([rows, rows - left, rows - up, rows - mean, rows - paeth(left, up, corner)])


def choose(made: np.ndarray) -> np.ndarray:
    """For each row the first filter with the least sum of absolute (signed) bytes."""
    return np.abs(made.view(np.int8).astype(np.int32)).sum(axis=2).argmin(axis=0)


def _layout(kind: int, depth: int, alpha: bool) -> int:
    """Channels that the samples come out with; 16-bit gray with alpha is widened."""
    n = {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}[kind] + (alpha and kind in (0, 2, 3))
    return 4 if depth == 16 and n == 2 else n


def decode(data: bytes, limits: Limits = Limits()) -> np.ndarray:
    found: dict[bytes, bytes] = {}
    body = []
    for name, part in chunks(data):
        if name == b"IDAT":
            body.append(part)
        elif name in (b"IHDR", b"PLTE", b"tRNS"):
            found.setdefault(name, part)
        elif not name[0] & 32 and name != b"IEND":
            raise unsupported(f"critical chunk {name!r}")
    if b"IHDR" not in found or not body:
        raise malformed("no header or no samples")
    width, height, depth, kind, interlace = header(found[b"IHDR"], limits)
    n = TYPES[kind][0]
    passes = [(x, y, dx, dy, -(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in (ADAM7 if interlace else ((0, 0, 1, 1),))]
    passes = [p for p in passes if p[4] > 0 and p[5] > 0]
    sizes = [p[5] * (1 + (p[4] * n * depth + 7) // 8) for p in passes]
    flat, at = inflate(b"".join(body), sum(sizes)), 0
    a = np.zeros((height, width, n), np.uint16 if depth == 16 else np.uint8)
    for (x, y, dx, dy, w, h), size in zip(passes, sizes):
        rows = unfilter(flat[at : at + size], h, (w * n * depth + 7) // 8, max(1, n * depth // 8))
        at += size
        part = np.ascontiguousarray(rows).view(">u2").astype(np.uint16) if depth == 16 else unpack(rows, depth, w * n)
        a[y::dy, x::dx] = part.reshape(h, w, n)
    key = found.get(b"tRNS")
    if kind == 3:
        table = np.frombuffer(found.get(b"PLTE", b""), np.uint8)
        if len(table) % 3 or not len(table) or a.max() >= len(table) // 3:
            raise malformed("an index is outside the palette")
        rgb = table.reshape(-1, 3)[a[..., 0]]
        if key is None:
            return rgb
        alpha = np.full(256, 255, np.uint8)
        alpha[: len(key)] = np.frombuffer(key[:256], np.uint8)
        return np.concatenate([rgb, alpha[a[..., 0]][..., None]], axis=2)
    if key is not None and kind in (0, 2):
        if len(key) < 2 * n:
            raise malformed("tRNS is too short")
        clear = (a == np.array(struct.unpack_from(f">{n}H", key), np.uint16)).all(axis=2)
        a = stretch(a, depth) if depth < 8 else a
        alpha = np.where(clear, 0, 65535 if depth == 16 else 255).astype(a.dtype)
        a = np.concatenate([a, alpha[..., None]], axis=2)
    elif depth < 8:
        a = stretch(a, depth)
    want = _layout(kind, depth, key is not None)
    return a if a.shape[2] == want else a[..., [0, 0, 0, 1]]


def chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", crc32(name + body))


def encode(a: np.ndarray, options: EncodeOptions = EncodeOptions(), filters: np.ndarray | None = None) -> bytes:
    """filters: one for each row, chosen by `choose` if not given."""
    if a.dtype.kind == "f":
        raise RasterError("unsupported", "PNG has no float samples")
    h, w, n = a.shape
    if max(h, w) >= 1 << 31:
        raise invalid("an axis is too long for PNG")
    depth, kind = a.dtype.itemsize * 8, {1: 0, 2: 4, 3: 2, 4: 6}[n]
    rows = np.ascontiguousarray(a.astype(">u2") if depth == 16 else a).reshape(h, -1).view(np.uint8)
    made = filtered(rows, n * depth // 8)
    pick = choose(made) if filters is None else np.asarray(filters)
    body = np.concatenate([pick.astype(np.uint8)[:, None], made[pick, np.arange(h)]], axis=1).tobytes()
    level = (options.quality - 1) * 8 // 99 + 1
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)) + chunk(b"IDAT", deflate(body, level)) + chunk(b"IEND", b"")
