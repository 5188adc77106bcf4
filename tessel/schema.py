"""Schemas and fixed codes of tiled image documents."""

from __future__ import annotations

from typing import NamedTuple

# Dimensions in their sort order.
DIMS = ("z", "c", "t", "r", "s", "i", "h", "v", "b")
DIM_COLUMNS = tuple(f"dim_{d}" for d in DIMS)

# Codes and names of the format.
PIXEL_TYPES = {"Gray8": 0, "Gray16": 1, "Gray32Float": 2, "Bgr24": 3, "Bgr48": 4, "Bgr96Float": 8, "Bgra32": 9, "Gray64ComplexFloat": 10, "Bgr192ComplexFloat": 11, "Gray32": 12, "Gray64Float": 13}
BYTES_PER_PIXEL = {"Gray8": 1, "Gray16": 2, "Gray32Float": 4, "Bgr24": 3, "Bgr48": 6, "Bgr96Float": 12, "Bgra32": 4, "Gray64ComplexFloat": 16, "Bgr192ComplexFloat": 24, "Gray32": 4, "Gray64Float": 8}
UNSUPPORTED = ("Bgra32", "Gray64ComplexFloat", "Bgr192ComplexFloat", "Gray32", "Gray64Float")
INVALID_PIXEL_TYPE = 255
COMPRESSIONS = {"UnCompressed": 0, "Jpg": 1, "JpgXr": 4, "Zstd0": 5, "Zstd1": 6}
PYRAMID_TYPES = {"None": 0, "SingleSubBlock": 1, "MultiSubBlock": 2}
# Fixed values: (factor of a layer, layer, minification, tolerance to both sides).
PYRAMID_TOLERANCES = (
    (2, 1, 2.0, 0.1), (2, 2, 4.0, 0.2), (2, 3, 8.0, 0.4), (2, 4, 16.0, 0.8), (2, 5, 32.0, 1.0), (2, 6, 64.0, 1.0), (2, 7, 128.0, 1.0), (2, 8, 256.0, 2.0), (2, 9, 512.0, 4.0), (2, 10, 1024.0, 10.0),
    (3, 1, 3.0, 0.1), (3, 2, 9.0, 0.2), (3, 3, 27.0, 0.8), (3, 4, 81.0, 1.5), (3, 5, 243.0, 2.0), (3, 6, 729.0, 5.0), (3, 7, 2187.0, 15.0),
)
INT_MAX, INT_MIN = 2**31 - 1, -(2**31)
#: Scene of a tile without one, and (factor, layer) of a tile that fits no pyramid, in pyramid statistics.
NO_SCENE, NO_LAYER = INT_MAX, 255

SUBBLOCKS = (
    "sb_index long, " + ", ".join(f"{c} int" for c in DIM_COLUMNS) + ", m_index int, x int, y int, w int, h int, stored_w int, stored_h int, pixel_type int, compression_raw int, pyramid_type int, file_position long"
)
ATTACHMENTS = "idx int, content_guid string, content_file_type string, name string, file_position long"


class Rect(NamedTuple):
    x: int
    y: int
    w: int
    h: int
