"""PNG files of bitmaps of 8 and 16 bits, grey and colour."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from tessel.functions.bitmaps import ARRAYS

# Fixed values of the format: its signature, and colour types of grey, RGB and RGBA.
_SIGNATURE, _COLOUR = b"\x89PNG\r\n\x1a\n", {1: 0, 3: 2, 4: 6}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(data: bytes, w: int, h: int, pixel_type: str, level: int = 6) -> bytes:
    """A file of samples in the order of the pixel type; floats are not for PNG."""
    kind, samples = ARRAYS[pixel_type]
    if pixel_type not in ("Gray8", "Gray16", "Bgr24", "Bgr48", "Bgra32"):
        raise ValueError(f"no PNG of {pixel_type}")
    image = np.frombuffer(data, kind).reshape(h, w, samples)
    if samples > 1:
        image = image[:, :, [2, 1, 0, 3][:samples]]
    lines = np.ascontiguousarray(image.astype(np.dtype(kind).newbyteorder(">"))).view(np.uint8).reshape(h, -1)
    rows = np.concatenate([np.zeros((h, 1), np.uint8), lines], axis=1).tobytes()  # 0: a line as it is
    head = struct.pack(">IIBBBBB", w, h, 8 * np.dtype(kind).itemsize, _COLOUR[samples], 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows, level)) + _chunk(b"IEND", b"")
