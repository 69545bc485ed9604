"""Array kernels on stacks of images: (images, rows, columns, channels).

One call works on a whole stack of equal size, so the cost of Python does not
grow with the number of images. Eight-bit samples use whole numbers in fixed
point; wider ones single precision, summed in the order of taps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from tessella.functions.types import RasterError, invalid
from tessella.functions.weights import Kernel, Weights, weights

f32 = np.float32


def crop(a, x, y, width, height):
    if width <= 0 or height <= 0 or x < 0 or y < 0 or x + width > a.shape[2] or y + height > a.shape[1]:
        raise invalid(f"crop {width}x{height}+{x}+{y} of {a.shape[2]}x{a.shape[1]}")
    return a[:, y : y + height, x : x + width]


def flip(a):
    return a[:, ::-1]


def flop(a):
    return a[:, :, ::-1]


def quarter_turns(degrees: int) -> int:
    if degrees % 90:
        raise invalid(f"a rotation of {degrees} degrees is no multiple of 90")
    return degrees // 90 % 4


def rotate(a, degrees):
    return np.rot90(a, -quarter_turns(degrees), axes=(1, 2))


def extract_channel(a, index):
    if a.dtype.kind == "f":
        raise RasterError("unsupported", "there is no gray format of floats")
    if not 0 <= index < a.shape[3]:
        raise invalid(f"channel {index} of {a.shape[3]}")
    return a[..., index : index + 1]


def flatten(a, background):
    if a.shape[3] in (1, 3):
        return a
    if a.dtype != np.uint8:
        raise RasterError("unsupported", "flatten of samples other than 8 bits")
    alpha, color = a[..., -1:].astype(np.int32), a[..., :-1].astype(np.int32)
    ground = np.array(background[: a.shape[3] - 1], np.int32)
    return ((color * alpha + ground * (255 - alpha) + 127) // 255).astype(np.uint8)


@dataclass(frozen=True)
class Modulate:
    brightness: float = 1.0
    saturation: float = 1.0
    hue: float = 0.0

    def __post_init__(self):
        for name in ("brightness", "saturation"):
            if not math.isfinite(getattr(self, name)) or getattr(self, name) < 0:
                raise invalid(f"{name} must be finite and not negative")
        if not math.isfinite(self.hue):
            raise invalid("hue must be finite")


def _store(v, dtype, scale):
    if dtype.kind == "f":
        return v.astype(f32)
    return np.floor(np.clip(v, f32(0), f32(1)) * f32(scale) + f32(0.5)).astype(dtype)


def modulate(a, m: Modulate):
    scale = {"u1": 255, "u2": 65535}.get(a.dtype.str[-2:], 1)
    out = a.copy()
    colors = a[..., : a.shape[3] - (a.shape[3] in (2, 4))].astype(f32) / f32(scale) if scale > 1 else a[..., : a.shape[3] - (a.shape[3] in (2, 4))].astype(f32)
    b, s, h = f32(m.brightness), f32(m.saturation), f32(m.hue)
    if colors.shape[-1] == 1:
        out[..., :1] = _store(colors * b, a.dtype, scale)
        return out
    r, g, bl = colors[..., 0], colors[..., 1], colors[..., 2]
    top, low = np.maximum(np.maximum(r, g), bl), np.minimum(np.minimum(r, g), bl)
    delta = top - low
    eps = np.finfo(f32).eps
    with np.errstate(divide="ignore", invalid="ignore"):
        hue = np.where(
            delta <= eps, f32(0),
            np.where(top == r, f32(60) * np.fmod((g - bl) / delta, f32(6)), np.where(top == g, f32(60) * ((bl - r) / delta + f32(2)), f32(60) * ((r - g) / delta + f32(4)))),
        )
        sat = np.where(top <= eps, f32(0), delta / top)
    hue = hue + h
    hue = np.fmod(hue, f32(360))
    hue = np.where(hue < 0, hue + f32(360), hue)
    sat, val = np.clip(sat * s, f32(0), f32(1)), np.clip(top * b, f32(0), f32(1))
    c = val * sat
    sixth = hue / f32(60)
    x = c * (f32(1) - np.abs(np.fmod(sixth, f32(2)) - f32(1)))
    base = val - c
    k = np.minimum(np.trunc(sixth), 5).astype(np.int8)
    zero = np.zeros_like(c)
    red = np.choose(k, [c, x, zero, zero, x, c]) + base
    green = np.choose(k, [x, c, c, x, zero, zero]) + base
    blue = np.choose(k, [zero, zero, x, c, c, x]) + base
    for i, v in enumerate((red, green, blue)):
        out[..., i] = _store(v, a.dtype, scale)
    return out


def _clamp16(v):
    return np.floor(np.clip(v, f32(0), f32(65535)) + f32(0.5)).astype("<u2")


def _round8(acc):
    return np.clip((acc + 8192) >> 14, 0, 255).astype(np.uint8)


def convolve(a, kernel: Kernel):
    """Edges repeat their nearest pixel; every channel is treated alike."""
    n, h, w, _ = a.shape
    ry, rx = kernel.height // 2, kernel.width // 2
    rows, cols = np.clip(np.arange(-ry, h + ry), 0, h - 1), np.clip(np.arange(-rx, w + rx), 0, w - 1)
    wide = a[:, rows][:, :, cols]
    narrow = a.dtype == np.uint8
    wide = wide.astype(np.int32 if narrow else f32)
    taps = kernel.fixed if narrow else kernel.exact
    acc = np.zeros(a.shape, np.int32 if narrow else f32)
    for dy in range(kernel.height):
        for dx in range(kernel.width):
            if not narrow or taps[dy, dx]:
                acc += wide[:, dy : dy + h, dx : dx + w] * (np.int32 if narrow else f32)(taps[dy, dx])
    if narrow:
        return _round8(acc)
    return _clamp16(acc) if a.dtype.kind == "u" else acc


def _blocks(w: Weights, table: np.ndarray, dtype, inputs: int):
    """(outputs, inputs, matrix) for runs of outputs that use about so many
    inputs, as dense bands."""
    outs, step = len(w.start), max(1, min(32, 1 + inputs * len(w.start) // int((w.start + w.length)[-1])))
    for first in range(0, outs, step):
        last = min(outs, first + step)
        lo, hi = w.span(first, last)
        band = np.zeros((last - first, hi - lo), dtype)
        rows = np.repeat(np.arange(last - first), w.length[first:last])
        taps = np.arange(table.shape[1]) < w.length[first:last, None]
        band[rows, (w.start[first:last, None] - lo + np.arange(table.shape[1]))[taps]] = table[first:last][taps]
        yield slice(first, last), slice(lo, hi), band


def _resample(a, w: Weights, axis: int):
    """One pass along an axis; rounds to the sample type. Each block of outputs
    is a product of a banded matrix with the inputs it uses. Eight-bit sums stay
    below 2**24, so single precision holds them exactly; a table that could
    exceed that is summed in double precision."""
    if a.dtype != np.uint8:
        return _resample_wide(a, w, axis)
    small = int(np.abs(w.fixed).sum(axis=1).max()) * 255 + 8192 < 1 << 24
    dtype = f32 if small else np.float64
    n, h, width, c = a.shape
    out_shape = [*a.shape]
    out_shape[axis] = len(w.start)
    out = np.empty(out_shape, np.uint8)
    bands = list(_blocks(w, w.fixed, dtype, 64 if axis == 2 else 256))
    if axis == 2:  # samples of a line lie by place, then channel
        bands = [(slice(o.start * c, o.stop * c), slice(i.start * c, i.stop * c), np.kron(band.T, np.eye(c, dtype=dtype))) for o, i, band in bands]
    lines = max(1, (1 << 20) // (width * c)) if axis == 2 else h
    for k in range(n):
        for at in range(0, h, lines) if axis == 2 else (0,):
            part = a[k, at : at + lines]
            if axis == 2:
                flat, made = part.reshape(len(part), -1).astype(dtype), np.empty((len(part), len(w.start) * c), dtype)
                for outs, ins, band in bands:
                    np.matmul(flat[:, ins], band, out=made[:, outs])
                out[k, at : at + lines] = np.clip(np.floor((made + 8192) / 16384), 0, 255).reshape(len(part), -1, c).astype(np.uint8)
            else:
                for outs, ins, band in bands:
                    made = band @ part[ins].reshape(ins.stop - ins.start, -1).astype(dtype)
                    out[k, outs] = np.clip(np.floor((made + 8192) / 16384), 0, 255).reshape(-1, width, c).astype(np.uint8)
    return out


def _resample_wide(a, w: Weights, axis: int):
    """Single precision, summed in the order of taps."""
    out_shape = list(a.shape)
    out_shape[axis] = len(w.start)
    acc = np.zeros(out_shape, f32)
    shape = [1] * a.ndim
    shape[axis] = -1
    for k in range(w.exact.shape[1]):
        tap = w.exact[:, k]
        if tap.any():
            acc += a.take(np.minimum(w.start + k, a.shape[axis] - 1), axis).astype(f32) * tap.reshape(shape)
    return _clamp16(acc) if a.dtype.kind == "u" else acc


def resize(a, width, height, name="lanczos3"):
    """Columns first, then rows, rounded in between."""
    if width <= 0 or height <= 0:
        raise invalid(f"cannot resize to {width}x{height}")
    a = _resample(a, weights(name, a.shape[2], width), 2)
    return _resample(a, weights(name, a.shape[1], height), 1)


def composite(base, overlay, dx=0, dy=0, blend="over"):
    if base.dtype != overlay.dtype or base.shape[3] != overlay.shape[3]:
        raise invalid("composite of different pixel formats")
    if base.dtype != np.uint8:
        raise RasterError("unsupported", "composite of samples other than 8 bits")
    if blend not in ("over", "source"):
        raise invalid(f"no blend {blend!r}")
    out = base.copy()
    x0, y0 = max(0, dx), max(0, dy)
    x1, y1 = min(base.shape[2], dx + overlay.shape[2]), min(base.shape[1], dy + overlay.shape[1])
    if x0 >= x1 or y0 >= y1:
        return out
    under = base[:, y0:y1, x0:x1].astype(np.int64)
    upper = overlay[:, y0 - dy : y1 - dy, x0 - dx : x1 - dx].astype(np.int64)
    if blend == "source" or base.shape[3] in (1, 3):
        out[:, y0:y1, x0:x1] = upper
        return out
    sa, ba = upper[..., -1:], under[..., -1:]
    rest = ba * (255 - sa)
    total = sa * 255 + rest
    safe = np.maximum(total, 1)
    color = np.minimum(255, (upper[..., :-1] * sa * 255 + under[..., :-1] * rest + total // 2) // safe)
    alpha = np.minimum(255, (total + 127) // 255)
    out[:, y0:y1, x0:x1] = np.where(total == 0, 0, np.concatenate([color, alpha], axis=-1)).astype(np.uint8)
    return out


def saturating_sum(a, b):
    if a.shape != b.shape or a.dtype != np.uint8 or b.dtype != np.uint8:
        raise invalid("a sum needs two images of one 8-bit shape")
    return np.minimum(255, a.astype(np.int32) + b).astype(np.uint8)
