"""Bitmaps as numpy arrays (height, width, samples), and conversions between their pixel types."""

from __future__ import annotations

import numpy as np

#: Type and number of the samples of a pixel, of those that are painted; "index" holds numbers of tiles.
ARRAYS = {"Gray8": (np.uint8, 1), "Gray16": (np.uint16, 1), "Gray32Float": (np.float32, 1), "Bgr24": (np.uint8, 3), "Bgr48": (np.uint16, 3), "Bgra32": (np.uint8, 4), "index": (np.int64, 1)}


def bitmap(data: bytes, pixel_type: str, w: int, h: int) -> np.ndarray:
    """The samples of a tile. Of too many bytes the first count, missing ones are 0."""
    if pixel_type not in ARRAYS:
        raise ValueError(f"no bitmap of {pixel_type}")
    kind, samples = ARRAYS[pixel_type]
    need = w * h * samples * np.dtype(kind).itemsize
    return np.frombuffer(data[:need].ljust(need, b"\0"), kind).reshape(h, w, samples)


def convert(v: np.ndarray, source: str, target: str) -> np.ndarray:
    """The same samples in another pixel type; a pair without a rule is an error. 8-bit samples widen to 48-bit colour as they are."""
    if source == target:
        return v
    kind, samples = ARRAYS.get(target, (None, 0))
    wide = v.astype(np.int64) if v.dtype != np.float32 else v
    grey, colour = ("Gray8", "Gray16"), ("Bgr24", "Bgr48")
    if source in grey and target == "Gray32Float":
        return v.astype(np.float32)
    if source in grey and target in grey + colour:
        eight = source == "Gray16" and target in ("Gray8", "Bgr24")
        return np.repeat((wide >> 8 if eight else wide).astype(kind), samples, axis=2)
    if source in colour and target == "Gray32Float":
        return (wide.sum(axis=2, keepdims=True) / 3).astype(np.float32)
    if source in colour and target in grey:
        mean = (wide.sum(axis=2, keepdims=True) + (source == "Bgr24")) // 3
        return (mean >> 8 if source == "Bgr48" and target == "Gray8" else mean).astype(kind)
    if source in colour and target in colour:
        return (wide >> 8 if source == "Bgr48" else wide).astype(kind)
    raise ValueError(f"no conversion from {source} to {target}")
