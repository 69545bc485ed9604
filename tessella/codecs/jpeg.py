"""JPEG by Huffman scans, sequential and progressive, of any subsampling,
restarts, gray, YCbCr and RGB, whole or at 1/2, 1/4 and 1/8 of the size; and a
baseline encoder.

Symbols are read one by one; everything else (dequantising, transforms, colour)
runs on all blocks at once. A progressive file holds all its coefficients until
the last scan, so its size is bounded by `PROGRESSIVE` bytes.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from tessella.codecs.bits import malformed, unsupported
from tessella.functions.types import EncodeOptions, Limits, RasterError, invalid

# The standard's quantisation tables for luma and chroma, row by row.
LUMA = (16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99)
CHROMA = (17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99) + (99,) * 32
# Colour weights in 1/65536 (to YCbCr with what is added; to RGB from Cb and Cr).
TO_YCBCR = ((19595, 38470, 7471, 0), (-11059, -21709, 32768, 128), (32768, -27439, -5329, 128))
TO_RGB = ((0, 91881), (-22554, -46802), (116130, 0))
#: The most bytes of decoded samples for a progressive file.
PROGRESSIVE = 256 << 20


def _zigzag() -> np.ndarray:
    """Places of a block (row by row) in the order of its diagonals."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    return np.array([8 * r + c for r, c in sorted(cells, key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])


ZIGZAG = _zigzag()
#: Rows: the basis waves of the transform.
WAVES = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])


def idct(blocks: np.ndarray, size: int = 8) -> np.ndarray:
    """Samples of (n, 8, 8) coefficients; size below 8: box means of the whole transform."""
    waves = WAVES.reshape(8, size, 8 // size).mean(axis=2)
    return np.einsum("ky,nkl,lx->nyx", waves, blocks, waves, optimize=True)


def fdct(blocks: np.ndarray) -> np.ndarray:
    return np.einsum("ky,nyx,lx->nkl", WAVES, blocks, WAVES, optimize=True)


def quant_table(base: tuple[int, ...], quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base, np.int64) * scale + 50) // 100, 1, 255)


def _segments(data: bytes, at: int = 0):
    """(marker, body, where the body ends) from a place outside coded samples on."""
    if at == 0 and data[:2] != b"\xff\xd8":
        raise malformed("not a JPEG start")
    at = at or 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise malformed(f"no marker at {at}")
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0x01 or 0xD0 <= mark <= 0xD8:
            at += 2
            continue
        if mark == 0xD9:
            return
        size = struct.unpack_from(">H", data, at + 2)[0]
        if size < 2 or at + 2 + size > len(data):
            raise malformed(f"segment {mark:#x} is cut off")
        yield mark, data[at + 4 : at + 2 + size], at + 2 + size
        at += 2 + size


@dataclass
class Component:
    name: int
    h: int
    v: int
    table: int
    dc: int = 0
    ac: int = 0
    blocks: np.ndarray | None = None
    quant: np.ndarray | None = None


@dataclass
class Scan:
    """Which components a scan holds, which places of the diagonal order, and
    the bit it refines (`before` is 0 in a first scan) or starts at."""

    parts: list[Component]
    first: int
    last: int
    before: int
    bit: int
    start: int


@dataclass
class Header:
    width: int = 0
    height: int = 0
    parts: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[int, np.ndarray] = field(default_factory=dict)
    restart: int = 0
    transform: int | None = None
    orientation: int = 1
    progressive: bool = False
    scan: Scan | None = None


def code_table(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits that may come next: length * 256 + symbol, 0 if none."""
    out, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            if k >= len(symbols) or code >= 1 << length:
                raise malformed("a Huffman table is overfull")
            out[code << 16 - length : code + 1 << 16 - length] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def orientation_of(exif: bytes) -> int:
    """The orientation that an Exif segment names, 1 if none."""
    order = {b"II": "<", b"MM": ">"}.get(exif[6:8])
    if exif[:6] != b"Exif\0\0" or order is None or len(exif) < 14:
        return 1
    at = 6 + struct.unpack_from(order + "I", exif, 10)[0]
    if at + 2 > len(exif):
        return 1
    for k in range(struct.unpack_from(order + "H", exif, at)[0]):
        if at + 14 + 12 * k > len(exif):
            return 1
        tag, kind, count, value = struct.unpack_from(order + "HHIH", exif, at + 2 + 12 * k)
        if tag == 0x112 and kind == 3 and count == 1:
            return value if 1 <= value <= 8 else 1
    return 1


def _tables(f: Header, mark: int, body: bytes) -> None:
    """Takes in what may stand before any scan: tables and the restart interval."""
    if mark == 0xDB:
        at = 0
        while at < len(body):
            wide, k = body[at] >> 4, body[at] & 15
            n = 128 if wide else 64
            if len(body) < at + 1 + n:
                raise malformed("a quantisation table is cut off")
            table = np.zeros(64, np.int64)
            table[ZIGZAG] = np.frombuffer(body[at + 1 : at + 1 + n], ">u2" if wide else np.uint8)
            f.quant[k], at = table, at + 1 + n
    elif mark == 0xC4:
        at = 0
        while at + 17 <= len(body):
            counts = body[at + 1 : at + 17]
            f.codes[body[at]] = code_table(counts, body[at + 17 : at + 17 + sum(counts)])
            at += 17 + sum(counts)
    elif mark == 0xDD and len(body) >= 2:
        f.restart = struct.unpack(">H", body[:2])[0]


def _scan(f: Header, body: bytes, end: int) -> Scan:
    if not f.parts:
        raise malformed("a scan without a frame")
    n = body[0] if body else 0
    if not 1 <= n <= len(f.parts) or len(body) < 4 + 2 * n:
        raise malformed("the scan header is cut off")
    parts = []
    for k in range(n):
        part = next((p for p in f.parts if p.name == body[1 + 2 * k]), None)
        if part is None or part in parts:
            raise malformed(f"a scan of component {body[1 + 2 * k]}")
        part.dc, part.ac = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
        parts.append(part)
    first, last, before, bit = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
    if not f.progressive:
        first, last, before, bit = 0, 63, 0, 0
    elif not (first == last == 0 or 0 < first <= last < 64 and n == 1) or bit > 13 or before not in (0, bit + 1):
        raise malformed(f"a scan of places {first} to {last}, bits {before} to {bit}")
    return Scan(parts, first, last, before, bit, end)


def header(data: bytes, limits: Limits = Limits()) -> Header:
    """Everything up to the first scan."""
    out = Header()
    for mark, body, end in _segments(data):
        if mark in (0xC0, 0xC1, 0xC2):
            if len(body) < 6 or len(body) < 6 + 3 * body[5]:
                raise malformed("the frame header is cut off")
            depth, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or n not in (1, 3):
                raise unsupported(f"JPEG with {n} components of {depth} bits")
            if not out.width or not out.height:
                raise malformed("no size")
            limits.check(out.width, out.height)
            out.progressive = mark == 0xC2
            if out.progressive and out.width * out.height * n > PROGRESSIVE:
                raise RasterError("limit_exceeded", f"a progressive JPEG of {out.width} x {out.height}")
            out.parts = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            if any(not 1 <= p.h <= 4 or not 1 <= p.v <= 4 for p in out.parts):
                raise malformed("sampling factors")
        elif 0xC3 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            raise unsupported(f"JPEG process {mark:#x}")
        elif mark == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            out.transform = body[11]
        elif mark == 0xE1 and body[:6] == b"Exif\0\0":
            out.orientation = orientation_of(body)
        elif mark == 0xDA:
            out.scan = _scan(out, body, end)
            return out
        else:
            _tables(out, mark, body)
    raise malformed("no scan")


def size_of(data: bytes) -> tuple[int, int]:
    for mark, body, _ in _segments(data):
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            return struct.unpack_from(">xHH", body)[::-1]
    raise malformed("no frame")


def is_progressive(data: bytes) -> bool:
    return next((mark for mark, _, _ in _segments(data) if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)), 0) == 0xC2


def _stretches(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The coded bytes between restarts, without stuffing, and where they end."""
    out, start = [], at
    while True:
        k = data.find(b"\xff", at)
        if k < 0 or k + 1 >= len(data):
            out.append(data[start:].replace(b"\xff\0", b"\xff"))
            return out, len(data)
        if data[k + 1] in (0, 0xFF):
            at = k + 2 if data[k + 1] == 0 else k + 1
            continue
        out.append(data[start:k].replace(b"\xff\0", b"\xff"))
        if not 0xD0 <= data[k + 1] <= 0xD7:
            return out, k
        start = at = k + 2


class Bits:
    """Reads a stretch from its highest bits on; beyond its end come ones."""

    WINDOW = 64  # bytes held as one number; long numbers are slow to shift

    def __init__(self, part: bytes):
        self.part, self.total, self.at, self.base, self.held = part, 8 * len(part), 0, 0, 0
        self._fill()

    def _fill(self) -> None:
        at = self.at >> 3
        self.base, self.held = 8 * at, int.from_bytes(self.part[at : at + self.WINDOW].ljust(self.WINDOW, b"\xff"), "big")

    def bits(self, n: int) -> int:
        if self.at - self.base + n > 8 * self.WINDOW:
            self._fill()
        self.at += n
        return self.held >> 8 * self.WINDOW - (self.at - self.base) & (1 << n) - 1

    def symbol(self, table: list[int]) -> int:
        if self.at - self.base + 16 > 8 * self.WINDOW:
            self._fill()
        got = table[self.held >> 8 * self.WINDOW - 16 - (self.at - self.base) & 0xFFFF]
        if not got or self.at > self.total:
            raise malformed("coded samples end or make no sense")
        self.at += got >> 8
        return got & 255

    def value(self, size: int) -> int:
        """A signed number of so many bits; the lower half is negative."""
        got = self.bits(size) if size else 0
        return got if not size or got >> size - 1 else got - (1 << size) + 1


def _sequential(r: Bits, block: memoryview, at: int, last: int, dc: list[int], ac: list[int], places: list[int]) -> int:
    """Reads one block at a place of `block`; returns its first coefficient. The
    reader's calls are written out, as this is where most files spend their time."""
    size = r.symbol(dc)
    if size > 15:
        raise malformed("a coefficient of too many bits")
    block[at] = last = last + r.value(size)
    k, left, held, least = 1, 8 * r.WINDOW + r.base - r.at, r.held, 8 * r.WINDOW + r.base - r.total
    while k < 64:
        if left < 32:
            r.at = r.base + 8 * r.WINDOW - left
            r._fill()
            left, held, least = 8 * r.WINDOW + r.base - r.at, r.held, 8 * r.WINDOW + r.base - r.total
        got = ac[held >> left - 16 & 0xFFFF]
        if not got or left < least:
            raise malformed("coded samples end or make no sense")
        left -= got >> 8
        size = got & 15
        if not size:
            if got & 255 < 0xF0:
                break
            k += 16
            continue
        k += got >> 4 & 15
        if k > 63:
            raise malformed("a run leaves its block")
        left -= size
        value = held >> left & (1 << size) - 1
        block[at + places[k]] = value if value >> size - 1 else value - (1 << size) + 1
        k += 1
    r.at = r.base + 8 * r.WINDOW - left
    return last


def _band(r: Bits, block: memoryview, at: int, rest: int, scan: Scan, ac: list[int], places: list[int]) -> int:
    """First scan of a band. `rest`: blocks, this one included, that a symbol
    before has declared empty; returns what is left of them."""
    if rest:
        return rest - 1
    k = scan.first
    while k <= scan.last:
        got = r.symbol(ac)
        run, size = got >> 4, got & 15
        if not size:
            if run < 15:
                return (1 << run) + r.bits(run) - 1
            k += 16
            continue
        k += run
        if k > scan.last:
            raise malformed("a run leaves its band")
        block[at + places[k]] = r.value(size) << scan.bit
        k += 1
    return 0


def _refine(r: Bits, block: memoryview, at: int, rest: int, scan: Scan, ac: list[int], places: list[int]) -> int:
    """A further bit of a band: one for each coefficient that is set already, and
    new coefficients of size one after runs that count the unset places alone."""
    step, k = 1 << scan.bit, scan.first
    while k <= scan.last:
        run, new = 64, 0  # in empty blocks only the set coefficients get bits
        if not rest:
            got = r.symbol(ac)
            run = got >> 4
            if got & 15 > 1:
                raise malformed("a new coefficient of more than one bit")
            if got & 15:
                new = step if r.bits(1) else -step
            elif run < 15:
                rest, run = (1 << run) + r.bits(run), 64
        while k <= scan.last:
            place, k = at + places[k], k + 1
            old = block[place]
            if old:
                if r.bits(1):
                    block[place] = old + step if old > 0 else old - step
            elif run:
                run -= 1
            else:
                block[place] = new
                break
    return rest - 1 if rest else 0


def _read_scan(f: Header, scan: Scan, parts: list[bytes]) -> None:
    hm, vm = max(p.h for p in f.parts), max(p.v for p in f.parts)
    if len(scan.parts) == 1:  # only blocks that hold samples of the image are coded
        p = scan.parts[0]
        across, down = -(-f.width * p.h // (8 * hm)), -(-f.height * p.v // (8 * vm))
        units = [(p, 0, 0, 1, 1)]
    else:
        across, down = -(-f.width // (8 * hm)), -(-f.height // (8 * vm))
        units = [(p, y, x, p.v, p.h) for p in scan.parts for y in range(p.v) for x in range(p.h)]
    codes = {}
    for p in scan.parts:
        needed = [p.dc] * (scan.first == 0 and not scan.before) + [16 + p.ac] * (scan.last > 0)
        if any(k not in f.codes for k in needed) or p.table not in f.quant:
            raise malformed("a table is missing")
        if p.quant is None:
            p.quant = f.quant[p.table]
        codes |= {k: f.codes[k].tolist() for k in needed if k not in codes}
    plan = [(scan.parts.index(p), memoryview(p.blocks).cast("B").cast("i"), p.blocks.shape[1], y, x, v, h, codes.get(p.dc), codes.get(16 + p.ac)) for p, y, x, v, h in units]
    places, count, done = ZIGZAG.tolist(), across * down, 0
    each = f.restart or count
    band = _refine if scan.before else _band
    for part in parts:
        if done >= count:
            break
        r, last, rest = Bits(part), [0] * len(scan.parts), 0
        for unit in range(done, min(count, done + each)):
            my, mx = divmod(unit, across)
            for c, block, stride, y, x, v, h, dc, ac in plan:
                at = 64 * ((my * v + y) * stride + mx * h + x)
                if not f.progressive:
                    last[c] = _sequential(r, block, at, last[c], dc, ac, places)
                elif scan.first:
                    rest = band(r, block, at, rest, scan, ac, places)
                elif scan.before:
                    block[at] |= r.bits(1) << scan.bit
                else:
                    size = r.symbol(dc)
                    if size > 15:
                        raise malformed("a coefficient of too many bits")
                    last[c] += r.value(size)
                    block[at] = last[c] << scan.bit
            done = unit + 1
            if r.at > r.total:
                raise malformed("coded samples end too early")
    if done < count:
        raise malformed(f"{done} of {count} units")


def coefficients(data: bytes, f: Header) -> None:
    """Fills in each component's blocks (rows, columns, 64), quantised, row by row.
    A sequential file ends when every component has been read, a progressive one
    at its end marker."""
    if len(f.parts) == 1:
        f.parts[0].h = f.parts[0].v = 1
    hm, vm = max(p.h for p in f.parts), max(p.v for p in f.parts)
    across, down = -(-f.width // (8 * hm)), -(-f.height // (8 * vm))
    for p in f.parts:
        p.blocks = np.zeros((down * p.v, across * p.h, 64), np.int32)
    scan = f.scan
    while scan:
        parts, end = _stretches(data, scan.start)
        _read_scan(f, scan, parts)
        if not f.progressive and all(p.quant is not None for p in f.parts):
            return
        scan = None
        for mark, body, at in _segments(data, end):
            if mark == 0xDA:
                scan = _scan(f, body, at)
                break
            _tables(f, mark, body)
        else:
            if f.progressive and data.rfind(b"\xff\xd9") < end:
                raise malformed("the file ends before its last scan")
    if any(p.quant is None for p in f.parts):
        raise malformed("a component without a scan")


def fitting(width: int, height: int, to_width: int, to_height: int) -> int:
    """The coarsest of 8, 4, 2 and 1 that leaves both axes at least as long."""
    return next(s for s in (8, 4, 2, 1) if s == 1 or (-(-width // s) >= to_width and -(-height // s) >= to_height))


def decode(data: bytes, limits: Limits = Limits(), scale: int = 1) -> np.ndarray:
    """scale: 1, 2, 4 or 8, by which both axes shrink (rounded up)."""
    if scale not in (1, 2, 4, 8):
        raise invalid(f"a scale of {scale}")
    f = header(data, limits)
    coefficients(data, f)
    width, height = -(-f.width // scale), -(-f.height // scale)
    hm, vm = max(p.h for p in f.parts), max(p.v for p in f.parts)
    planes = []
    for p in f.parts:
        down, across, _ = p.blocks.shape
        made = idct((p.blocks.reshape(-1, 64) * p.quant).reshape(-1, 8, 8).astype(np.float64), 8 // scale)
        plane = np.clip(np.floor(made + 128.5), 0, 255).astype(np.uint8).reshape(down, across, 8 // scale, -1).transpose(0, 2, 1, 3).reshape(down * 8 // scale, -1)
        rows, columns = np.arange(height) * p.v // vm, np.arange(width) * p.h // hm
        planes.append(plane[rows][:, columns])
    a = np.stack(planes, axis=2)
    rgb = f.transform == 0 or (f.transform is None and [p.name for p in f.parts] == [82, 71, 66])
    if len(planes) == 1 or rgb:
        return a
    y, cb, cr = a[..., 0].astype(np.int64) << 16, a[..., 1].astype(np.int64) - 128, a[..., 2].astype(np.int64) - 128
    return np.stack([np.clip((y + b * cb + r * cr + 32768) >> 16, 0, 255) for b, r in TO_RGB], axis=2).astype(np.uint8)


def _lengths(counts: dict[int, int]) -> tuple[bytes, bytes]:
    """Code counts by length (at most 16) and symbols in order, for symbols that
    occur so often; no code is all ones."""
    heap = sorted([(n, 0, (s,)) for s, n in counts.items()] + [(0, 1, (-1,))], key=lambda x: (x[0], x[2]))
    length = {s: 0 for _, _, g in heap for s in g}
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heap[:2]
        for s in a + b:
            length[s] += 1
        heap = sorted([*heap[2:], (n + m, 0, a + b)], key=lambda x: (x[0], len(x[2]), x[2]))
    at = [0] * 64
    for n in length.values():
        at[n] += 1
    for n in range(63, 16, -1):  # too long ones: a pair moves up, a shorter one splits
        while at[n] > 0:
            up = next(k for k in range(n - 2, 0, -1) if at[k])
            at[n] -= 2
            at[n - 1] += 1
            at[up + 1] += 2
            at[up] -= 1
    at[max(k for k in range(64) if at[k])] -= 1  # the place of the reserved symbol
    return bytes(at[1:17]), bytes(s for s in sorted(length, key=lambda s: (length[s], s)) if s >= 0)


def _codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    out, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[symbols[k]] = code, length
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _symbols(block: list[int], before: int) -> list[tuple[int, int, int]]:
    """(symbol, extra bits, how many) of one block in zigzag order."""

    def sized(v: int) -> tuple[int, int]:
        n = abs(v).bit_length()
        return n, v if v > 0 else v + (1 << n) - 1

    n, extra = sized(block[0] - before)
    out, run = [(n, extra, n)], 0
    for v in block[1:]:
        if not v:
            run += 1
            continue
        while run > 15:
            out.append((0xF0, 0, 0))
            run -= 16
        n, extra = sized(v)
        out.append((run << 4 | n, extra, n))
        run = 0
    if run:
        out.append((0, 0, 0))
    return out


def encode(a: np.ndarray, options: EncodeOptions = EncodeOptions()) -> bytes:
    """Gray or YCbCr, chroma whole from quality 90 on, else halved; alpha is
    blended onto black. The Huffman tables are made for the image."""
    if a.dtype != np.uint8:
        raise unsupported("JPEG takes 8-bit samples")
    h, w, n = a.shape
    if max(h, w) > 65535:
        raise invalid("an axis is too long for JPEG")
    color = a[..., : n - (n in (2, 4))].astype(np.int64)
    if n in (2, 4):
        color = (color * a[..., -1:] + 127) // 255
    gray = color.shape[2] == 1
    half = 1 if gray or options.quality >= 90 else 2
    planes = [color[..., 0]] if gray else [((color @ np.array(row[:3])) + 32768 >> 16) + row[3] for row in TO_YCBCR]
    planes = [np.clip(p, 0, 255) for p in planes]
    tables = [quant_table(LUMA, options.quality), quant_table(CHROMA, options.quality)]
    across, down = -(-w // (8 * half)), -(-h // (8 * half))
    made = []
    for k, p in enumerate(planes):
        p = np.pad(p, ((0, down * 8 * half - h), (0, across * 8 * half - w)), mode="edge")
        if k and half == 2:
            p = (p.reshape(down * 8, 2, across * 8, 2).sum(axis=(1, 3)) + 2) // 4
        blocks = p.reshape(p.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3)
        flat = fdct(blocks.reshape(-1, 8, 8) - 128.0).reshape(-1, 64) / tables[k > 0]
        made.append((np.sign(flat) * np.floor(np.abs(flat) + 0.5)).astype(np.int64)[:, ZIGZAG].reshape(*blocks.shape[:2], 64))
    stream, before = [], [0] * len(made)
    for my in range(down):
        for mx in range(across):
            for k, blocks in enumerate(made):
                side = half if k == 0 else 1
                for b in range(side * side):
                    block = blocks[my * side + b // side, mx * side + b % side].tolist()
                    stream.append((min(k, 1), _symbols(block, before[k])))
                    before[k] = block[0]
    seen: list[dict[int, int]] = [{}, {}, {}, {}]
    for kind, symbols in stream:
        for j, (s, _, _) in enumerate(symbols):
            table = seen[2 * kind + (j > 0)]
            table[s] = table.get(s, 0) + 1
    used = 1 if gray else 2
    specs = [_lengths(t) for t in seen[: 2 * used]]
    codes = [_codes(*s) for s in specs]
    out, held, bits = bytearray(), 0, 0
    for kind, symbols in stream:
        for j, (s, extra, width) in enumerate(symbols):
            code, length = codes[2 * kind + (j > 0)][s]
            held, bits = (held << length | code) << width | extra, bits + length + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1
    if bits:
        out.append((held << 8 - bits | (1 << 8 - bits) - 1) & 255)

    def segment(mark: int, body: bytes) -> bytes:
        return bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body

    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for k in range(used):
        head += segment(0xDB, bytes([k]) + bytes(tables[k][ZIGZAG].tolist()))
    parts = b"".join(bytes([k + 1, (half << 4 | half) if k == 0 else 0x11, min(k, 1)]) for k in range(len(made)))
    head += segment(0xC0, struct.pack(">BHHB", 8, h, w, len(made)) + parts)
    for k in range(used):
        for j in range(2):
            head += segment(0xC4, bytes([j << 4 | k]) + specs[2 * k + j][0] + specs[2 * k + j][1])
    scan = bytes([len(made)]) + b"".join(bytes([k + 1, 0x11 * min(k, 1)]) for k in range(len(made))) + bytes([0, 63, 0])
    return head + segment(0xDA, scan) + bytes(out).replace(b"\xff", b"\xff\0") + b"\xff\xd9"
