"""GIF: frames on a canvas, and single frames by median cut and error diffusion."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from tessella.codecs.bits import lzw_decode, lzw_encode, malformed, unsupported
from tessella.functions.types import EncodeOptions, Limits, invalid

# Rows of the four interlaced passes as first row and step; disposals.
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))
KEEP, BACKGROUND, PREVIOUS = 1, 2, 3


def size_of(data: bytes) -> tuple[int, int]:
    if len(data) < 13 or data[:6] not in (b"GIF87a", b"GIF89a"):
        raise malformed("not a GIF screen")
    return struct.unpack_from("<HH", data, 6)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The joined sub-blocks that start here, and where they end."""
    out = bytearray()
    while True:
        if at >= len(data):
            raise malformed("sub-blocks are cut off")
        n = data[at]
        out += data[at + 1 : at + 1 + n]
        at += 1 + n
        if not n:
            return bytes(out), at


def _table(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 128:
        return None, at
    n = 3 << (flags & 7) + 1
    if at + n > len(data):
        raise malformed("a colour table is cut off")
    return np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n


def interlaced(h: int) -> np.ndarray:
    """The rows in the order in which an interlaced frame brings them."""
    return np.concatenate([np.arange(first, h, step) for first, step in PASSES])


@dataclass
class Frame:
    x: int
    y: int
    index: np.ndarray
    known: np.ndarray
    table: np.ndarray
    clear: int | None
    disposal: int
    delay: int


def frames(data: bytes, limits: Limits = Limits()):
    """The frames of a file, not drawn yet."""
    width, height = size_of(data)
    limits.check(width, height)
    flags = data[10]
    common, at = _table(data, 13, flags)
    clear, disposal, delay = None, 0, 0
    while at < len(data) and data[at] != 0x3B:
        mark = data[at]
        if mark == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, struct.unpack_from("<H", body, 1)[0]
                disposal, clear = disposal if disposal < 4 else 0, body[3] if body[0] & 1 else None
            continue
        if mark != 0x2C or at + 10 > len(data):
            raise malformed(f"block {mark:#x}")
        x, y, w, h, own = struct.unpack_from("<HHHHB", data, at + 1)
        table, at = _table(data, at + 10, own)
        table = common if table is None else table
        if table is None:
            raise malformed("a frame without a colour table")
        if at >= len(data):
            raise malformed("a frame is cut off")
        limits.check(max(w, 1), max(h, 1))
        depth = data[at]
        body, at = _blocks(data, at + 1)
        if not 1 <= depth <= 11:
            raise malformed(f"codes of {depth} bits")
        got = np.frombuffer(lzw_decode(body, depth, w * h), np.uint8)
        flat, known = np.zeros(w * h, np.uint8), np.zeros(w * h, bool)
        flat[: len(got)], known[: len(got)] = got, True
        index, known = flat.reshape(h, w), known.reshape(h, w)
        if own & 64:
            order = interlaced(h)
            index, known = index[np.argsort(order)], known[np.argsort(order)]
        if index[known].size and index[known].max() >= len(table):
            raise malformed("an index is outside the colour table")
        yield Frame(x, y, index, known, table, clear, disposal, delay)
        clear, disposal, delay = None, 0, 0


def background(data: bytes) -> np.ndarray:
    """The background colour, transparent if there is no common table."""
    table, _ = _table(data, 13, data[10])
    return np.array([*table[data[11]], 255] if table is not None and data[11] < len(table) else [0, 0, 0, 0], np.uint8)


def canvases(data: bytes, limits: Limits = Limits()):
    """rgba8 canvases, one after each frame. A frame disposed of to the
    background leaves its rectangle transparent if it had a transparent index,
    else in the background colour."""
    width, height = size_of(data)
    canvas, undo = np.zeros((height, width, 4), np.uint8), None
    ground = background(data)
    for f in frames(data, limits):
        if undo is not None:
            place, old = undo
            canvas[place] = old
        h, w = max(0, min(f.index.shape[0], height - f.y)), max(0, min(f.index.shape[1], width - f.x))
        place = np.s_[f.y : f.y + h, f.x : f.x + w]
        undo = None
        if f.disposal == BACKGROUND:
            undo = place, (ground if f.clear is None else np.zeros(4, np.uint8))
        elif f.disposal == PREVIOUS:
            undo = place, canvas[place].copy()
        shown = f.known[:h, :w] & (f.index[:h, :w] != (-1 if f.clear is None else f.clear))
        drawn = np.concatenate([f.table[f.index[:h, :w]], np.full((h, w, 1), 255, np.uint8)], axis=2)
        canvas[place] = np.where(shown[..., None], drawn, canvas[place])
        yield canvas.copy()


def decode(data: bytes, limits: Limits = Limits()) -> np.ndarray:
    for canvas in canvases(data, limits):
        return canvas
    raise malformed("no frame")


def median_cut(rgb: np.ndarray, most: int) -> np.ndarray:
    """At most `most` colours for an image: the heaviest box that can be split
    (by cells, then by spread) is cut at the weighted median of its widest
    channel; a box gives its rounded mean."""
    colors, count = np.unique(rgb.reshape(-1, 3), axis=0, return_counts=True)
    if len(colors) <= most:  # cuts would end with a box for each
        return colors.astype(np.uint8)
    boxes = [(colors.astype(np.int64), count.astype(np.int64))]

    def rank(k: int) -> tuple[int, int]:
        c, n = boxes[k]
        return int(n.sum()), int((c.max(axis=0) - c.min(axis=0)).max())

    while len(boxes) < most:
        ready = [k for k in range(len(boxes)) if len(boxes[k][0]) > 1]
        if not ready:
            break
        c, n = boxes.pop(max(ready, key=lambda k: (rank(k), k)))
        order = np.argsort(c[:, int((c.max(axis=0) - c.min(axis=0)).argmax())], kind="stable")
        c, n = c[order], n[order]
        cut = min(len(c) - 1, max(1, int(np.searchsorted(np.cumsum(n), n.sum() / 2)) + 1))
        boxes += [(c[:cut], n[:cut]), (c[cut:], n[cut:])]
    means = [((c * n[:, None]).sum(axis=0) + n.sum() // 2) // n.sum() for c, n in boxes]
    return np.unique(np.array(means, np.uint8), axis=0)


def nearest(rgb: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The closest entry of the table, the first of equals."""
    colors, back = np.unique(rgb.reshape(-1, 3), axis=0, return_inverse=True)
    out = np.empty(len(colors), np.uint8)
    for at in range(0, len(colors), 1 << 14):
        far = ((colors[at : at + (1 << 14), None].astype(np.int32) - table[None].astype(np.int32)) ** 2).sum(axis=2)
        out[at : at + (1 << 14)] = far.argmin(axis=1)
    return out[back.reshape(-1)].reshape(rgb.shape[:-1])


def diffused(rgb: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Indices by error diffusion: 7, 3, 5 and 1 sixteenths of what a cell misses
    go right, down left, down and down right, cut towards zero."""
    h, w, _ = rgb.shape
    entries, wide, known = table.astype(int).tolist(), table.astype(np.int32), {}
    error = [[[0, 0, 0] for _ in range(w + 2)] for _ in range(2)]
    out = np.empty((h, w), np.uint8)
    for y in range(h):
        here, below = error[0], [[0, 0, 0] for _ in range(w + 2)]
        for x, cell in enumerate(rgb[y].tolist()):
            want = tuple(min(255, max(0, v + e)) for v, e in zip(cell, here[x + 1]))
            k = known.get(want)
            if k is None:
                k = known[want] = int(((wide - want) ** 2).sum(axis=1).argmin())  # the first of equals
            out[y, x] = k
            for c in range(3):
                miss = want[c] - entries[k][c]
                if miss:
                    for line, place, part in ((here, x + 2, 7), (below, x, 3), (below, x + 1, 5), (below, x + 2, 1)):
                        line[place][c] += int(miss * part / 16)
        error = [below, None]
    return out


def encode(a: np.ndarray, options: EncodeOptions = EncodeOptions(), dither: bool = True) -> bytes:
    """One frame; alpha is blended onto black. quality sets the colours, 2 to 256."""
    if a.dtype != np.uint8:
        raise unsupported("GIF takes 8-bit samples")
    h, w, n = a.shape
    if max(h, w) > 65535:
        raise invalid("an axis is too long for GIF")
    color = a[..., : n - (n in (2, 4))].astype(np.uint16)
    if n in (2, 4):
        color = (color * a[..., -1:] + 127) // 255
    rgb = (np.repeat(color, 3, axis=2) if color.shape[2] == 1 else color).astype(np.uint8)
    table = median_cut(rgb, 2 + (options.quality - 1) * 254 // 99)
    index = diffused(rgb, table) if dither else nearest(rgb, table)
    depth = max(1, int(len(table) - 1).bit_length())
    padded = np.zeros((1 << depth, 3), np.uint8)
    padded[: len(table)] = table
    body = lzw_encode(index.tobytes(), max(2, depth))
    blocks = b"".join(bytes([len(body[k : k + 255])]) + body[k : k + 255] for k in range(0, len(body), 255))
    screen = struct.pack("<HHBBB", w, h, 0xF0 | depth - 1, 0, 0)
    return b"GIF89a" + screen + padded.tobytes() + b"," + struct.pack("<HHHHB", 0, 0, w, h, 0) + bytes([max(2, depth)]) + blocks + b"\0;"
