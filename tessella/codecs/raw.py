"""Bare samples: rows one after another, each padded to a stride. There is no
header, so the reader is told the layout."""

from __future__ import annotations

import numpy as np

from tessella.codecs.bits import malformed
from tessella.functions.types import Descriptor, EncodeOptions, Limits, invalid, pixel


def decode(data: bytes, d: Descriptor, stride: int | None = None, limits: Limits = Limits()) -> np.ndarray:
    limits.check(d.width, d.height)
    stride = d.row_bytes if stride is None else stride
    if stride < d.row_bytes:
        raise invalid(f"a stride of {stride} for rows of {d.row_bytes} bytes")
    if len(data) < stride * (d.height - 1) + d.row_bytes:
        raise malformed(f"{len(data)} bytes end before row {d.height}")
    padded = np.frombuffer(data + bytes(stride), np.uint8)[: stride * d.height].reshape(d.height, stride)
    return np.ascontiguousarray(padded[:, : d.row_bytes]).view(pixel(d.pixel).dtype).reshape(d.shape)


def encode(a: np.ndarray, options: EncodeOptions = EncodeOptions(), stride: int | None = None) -> bytes:
    rows = np.ascontiguousarray(a).reshape(len(a), -1).view(np.uint8)
    stride = rows.shape[1] if stride is None else stride
    if stride < rows.shape[1]:
        raise invalid(f"a stride of {stride} for rows of {rows.shape[1]} bytes")
    return np.pad(rows, ((0, 0), (0, stride - rows.shape[1]))).tobytes()
