"""Pixel formats, geometry, limits and errors."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

CODES = ("io", "malformed", "unsupported", "limit_exceeded", "invalid_argument", "graph")
MAX_CELLS = 268_402_689
FORMATS = ("raw", "png", "jpeg", "gif", "tiff", "webp", "avif")


class RasterError(Exception):
    """An error with one of the stable codes."""

    def __init__(self, code: str, detail: str):
        assert code in CODES
        super().__init__(f"{code}: {detail}")
        self.code, self.detail = code, detail

    def __reduce__(self):
        return RasterError, (self.code, self.detail)


def invalid(detail: str) -> RasterError:
    return RasterError("invalid_argument", detail)


@dataclass(frozen=True)
class Pixel:
    """A pixel format: its layout and the type of its samples."""

    name: str
    channels: int
    dtype: str

    @property
    def full_scale(self) -> float:
        return {"u1": 255, "u2": 65535, "f4": 1.0}[self.dtype[-2:]]

    @property
    def alpha(self) -> bool:
        return self.channels in (2, 4)

    @property
    def bytes_per_pixel(self) -> int:
        return self.channels * np.dtype(self.dtype).itemsize


# The nine pixel formats.
LAYOUTS = {
    p.name: p
    for p in (
        Pixel("gray8", 1, "u1"), Pixel("graya8", 2, "u1"), Pixel("rgb8", 3, "u1"), Pixel("rgba8", 4, "u1"), Pixel("gray16", 1, "<u2"),
        Pixel("rgb16", 3, "<u2"), Pixel("rgba16", 4, "<u2"), Pixel("rgbf32", 3, "<f4"), Pixel("rgbaf32", 4, "<f4"),
    )
}


def pixel(name: str) -> Pixel:
    if name not in LAYOUTS:
        raise RasterError("unsupported", f"pixel format {name!r}")
    return LAYOUTS[name]


def pixel_of(channels: int, dtype: str) -> Pixel:
    for p in LAYOUTS.values():
        if p.channels == channels and p.dtype[-2:] == dtype[-2:]:
            return p
    raise RasterError("unsupported", f"{channels} channels of {dtype}")


@dataclass(frozen=True)
class Region:
    x: int
    y: int
    width: int
    height: int

    def __str__(self) -> str:
        return f"{self.width}x{self.height}+{self.x}+{self.y}"

    @property
    def right(self) -> int:
        return self.x + self.width

    @property
    def bottom(self) -> int:
        return self.y + self.height

    def contains(self, other: Region) -> bool:
        return self.x <= other.x and self.y <= other.y and other.right <= self.right and other.bottom <= self.bottom

    def intersect(self, other: Region) -> Region | None:
        x, y = max(self.x, other.x), max(self.y, other.y)
        w, h = min(self.right, other.right) - x, min(self.bottom, other.bottom) - y
        return Region(x, y, w, h) if w > 0 and h > 0 else None

    def union(self, other: Region) -> Region:
        x, y = min(self.x, other.x), min(self.y, other.y)
        return Region(x, y, max(self.right, other.right) - x, max(self.bottom, other.bottom) - y)

    def translate(self, dx: int, dy: int) -> Region:
        """Moved, with the corner held at 0."""
        return replace(self, x=max(0, self.x + dx), y=max(0, self.y + dy))


@dataclass(frozen=True)
class Limits:
    max_cells: int = MAX_CELLS

    def check(self, width: int, height: int) -> None:
        if width <= 0 or height <= 0:
            raise invalid(f"an image of {width}x{height} has no cells")
        if width * height > self.max_cells:
            raise RasterError("limit_exceeded", f"{width}x{height} is over {self.max_cells} cells")


@dataclass(frozen=True)
class Descriptor:
    width: int
    height: int
    pixel: str
    color: str = "srgb"

    def __post_init__(self):
        pixel(self.pixel)
        if self.width <= 0 or self.height <= 0:
            raise invalid(f"an image of {self.width}x{self.height} has no cells")

    @property
    def region(self) -> Region:
        return Region(0, 0, self.width, self.height)

    @property
    def row_bytes(self) -> int:
        return self.width * pixel(self.pixel).bytes_per_pixel

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.height, self.width, pixel(self.pixel).channels

    def resized(self, width: int, height: int) -> Descriptor:
        Limits().check(width, height)
        return replace(self, width=width, height=height)


@dataclass(frozen=True)
class EncodeOptions:
    quality: int = 80

    def __post_init__(self):
        if not 1 <= self.quality <= 100:
            raise invalid(f"quality {self.quality} is outside 1..=100")


def to_array(data: bytes, d: Descriptor) -> np.ndarray:
    """Packed bytes as an array of rows, columns and channels."""
    if len(data) != d.row_bytes * d.height:
        raise invalid(f"{len(data)} bytes for {d.width}x{d.height} {d.pixel}, which needs {d.row_bytes * d.height}")
    return np.frombuffer(data, pixel(d.pixel).dtype).reshape(d.shape)


def descriptor_of(a: np.ndarray) -> Descriptor:
    return Descriptor(a.shape[1], a.shape[0], pixel_of(a.shape[2], a.dtype.str).name)
