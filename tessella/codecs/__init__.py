"""Image files: decoders and encoders on NumPy arrays of rows, columns and channels.

`decode` and `encode` choose by content or by name. Every decoder checks the
size in the header against the limits before it allocates samples. WebP and AVIF
are known by name and answer `unsupported`.
"""

from __future__ import annotations

import numpy as np

from tessella.codecs import gif, jpeg, png, raw, tiff
from tessella.functions.types import EncodeOptions, Limits, RasterError
from tessella.sources.sniff import format_of

DECODERS = {"png": png.decode, "gif": gif.decode, "jpeg": jpeg.decode, "tiff": tiff.decode}
ENCODERS = {"png": png.encode, "gif": gif.encode, "jpeg": jpeg.encode, "tiff": tiff.encode, "raw": raw.encode}


def decode(data: bytes, limits: Limits = Limits()) -> np.ndarray:
    """The first (or only) image of a file."""
    name = format_of(data)
    if name is None:
        raise RasterError("unsupported", f"no known format starts with {data[:8].hex()}")
    if name not in DECODERS:
        raise RasterError("unsupported", f"{name} files cannot be decoded here")
    return DECODERS[name](data, limits)


def encode(a: np.ndarray, name: str, options: EncodeOptions = EncodeOptions()) -> bytes:
    if name not in ENCODERS:
        raise RasterError("unsupported", f"{name} files cannot be written here")
    return ENCODERS[name](a, options)


def size_of(data: bytes) -> tuple[int, int]:
    """Width and height, from the header alone."""
    name = format_of(data)
    readers = {"png": png.size_of, "gif": gif.size_of, "jpeg": jpeg.size_of, "tiff": tiff.size_of}
    if name not in readers:
        raise RasterError("unsupported", f"no header to read in {data[:8].hex()}")
    return readers[name](data)
