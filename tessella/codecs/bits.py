"""What several formats share: bit fields, run lengths, dictionaries, checksums."""

from __future__ import annotations

import zlib

import numpy as np

from tessella.functions.types import RasterError


def malformed(detail: str) -> RasterError:
    return RasterError("malformed", detail)


def unsupported(detail: str) -> RasterError:
    return RasterError("unsupported", detail)


def crc32(data: bytes) -> int:
    return zlib.crc32(data)


def adler32(data: bytes) -> int:
    return zlib.adler32(data)


def inflate(data: bytes, most: int) -> bytes:
    """A zlib stream of at most `most` bytes; a longer one is malformed."""
    run = zlib.decompressobj()
    try:
        out = run.decompress(data, most + 1)
    except zlib.error as e:
        raise malformed(f"zlib: {e}") from None
    if len(out) > most:
        raise malformed(f"the stream holds more than {most} bytes")
    return out


def deflate(data: bytes, level: int) -> bytes:
    return zlib.compress(data, level)


def unpack(rows: np.ndarray, depth: int, width: int) -> np.ndarray:
    """Rows of bytes as rows of `width` fields of 1, 2, 4 or 8 bits, high bits first."""
    if depth == 8:
        return rows[:, :width]
    each = 8 // depth
    shifts = np.arange(8 - depth, -1, -depth, dtype=np.uint8)
    return ((rows[:, :, None] >> shifts) & ((1 << depth) - 1)).reshape(len(rows), -1)[:, :width] if each else rows


def stretch(v: np.ndarray, depth: int) -> np.ndarray:
    """Samples of fewer than 8 bits over the whole range of 8."""
    top = (1 << depth) - 1
    return ((v.astype(np.uint16) * 255 + top // 2) // top).astype(np.uint8)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    if len(out) < size:
        raise malformed("run lengths end before the samples do")
    return bytes(out[:size])


def packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 2:
            out += bytes([257 - run, data[at]])
            at += run
            continue
        end = at + 1
        while end < len(data) and end - at < 128 and not (end + 2 < len(data) and data[end] == data[end + 1] == data[end + 2]):
            end += 1
        out += bytes([end - at - 1]) + data[at:end]
        at = end
    return bytes(out)


class _Fields:
    """Bit fields of changing width, least bit first or greatest bit first."""

    def __init__(self, data: bytes, high_first: bool):
        self.data, self.high, self.at, self.held, self.n = data, high_first, 0, 0, 0

    def take(self, width: int) -> int | None:
        while self.n < width:
            if self.at >= len(self.data):
                return None
            byte = self.data[self.at]
            self.held = self.held << 8 | byte if self.high else self.held | byte << self.n
            self.at, self.n = self.at + 1, self.n + 8
        self.n -= width
        if self.high:
            out = self.held >> self.n
            self.held &= (1 << self.n) - 1
        else:
            out = self.held & ((1 << width) - 1)
            self.held >>= width
        return out


def lzw_decode(data: bytes, depth: int, size: int, high_first: bool = False) -> bytes:
    """A dictionary stream over symbols of `depth` bits. high_first: greatest bit
    first, and the width grows one code early (TIFF); else as in GIF."""
    clear, end = 1 << depth, (1 << depth) + 1
    fields, out, words, last, width = _Fields(data, high_first), bytearray(), [], None, depth + 1
    start = [bytes([k & 255]) for k in range(clear)] + [b"", b""]
    words = list(start)
    while len(out) < size:
        code = fields.take(width)
        if code is None or code == end:
            break
        if code == clear:
            words, last, width = list(start), None, depth + 1
            continue
        if code < len(words):
            word = words[code]
        elif last is not None and code == len(words):
            word = last + last[:1]
        else:
            raise malformed("a dictionary code is out of reach")
        out += word
        if last is not None and len(words) < 4096:
            words.append(last + word[:1])
        last = word
        if len(words) + high_first >= 1 << width and width < 12:
            width += 1
    return bytes(out[:size])


def lzw_encode(data: bytes, depth: int, high_first: bool = False) -> bytes:
    clear, end = 1 << depth, (1 << depth) + 1
    out, held, n = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, n
        held = held << width | code if high_first else held | code << n
        n += width
        while n >= 8:
            n -= 8
            out.append(held >> n & 255 if high_first else held & 255)
            held = held & ((1 << n) - 1) if high_first else held >> 8

    start = {bytes([k]): k for k in range(min(256, clear))}
    words, width, following, word = dict(start), depth + 1, end + 1, b""
    put(clear, width)
    for k in range(len(data)):
        symbol = data[k : k + 1]
        if word + symbol in words:
            word += symbol
            continue
        put(words[word], width)
        words[word + symbol] = following
        following += 1
        if following + high_first > 1 << width and width < 12:
            width += 1
        if following >= 4094:
            put(clear, width)
            words, width, following = dict(start), depth + 1, end + 1
        word = symbol
    if word:
        put(words[word], width)
        following += 1
        if following + high_first > 1 << width and width < 12:
            width += 1
    put(end, width)
    if n:
        out.append((held << (8 - n) if high_first else held) & 255)
    return bytes(out)


def to_little(a: np.ndarray, big: bool) -> np.ndarray:
    return a.astype(a.dtype.newbyteorder("<")) if big else a
