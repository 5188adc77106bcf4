"""Payload codecs, chunk containers and bitonal masks: numpy and zstandard, applied in Arrow batches."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.schema import BYTES_PER_PIXEL, COMPRESSIONS, PIXEL_TYPES

_NAMES = {v: k for k, v in PIXEL_TYPES.items()}
#: Fixed value: the chunk that holds a mask of valid pixels.
VALID_PIXELS = uuid.UUID("cbe3ea67-5bfc-492b-a16a-ece378031448")


def hi_lo_pack(data: bytes) -> bytes:
    """16-bit samples as all low bytes, then all high bytes."""
    both = np.frombuffer(data, np.uint8).reshape(-1, 2)
    return both[:, 0].tobytes() + both[:, 1].tobytes()


def hi_lo_unpack(data: bytes) -> bytes:
    half = np.frombuffer(data, np.uint8).reshape(2, -1)
    return half.T.tobytes()


def _sized(data: bytes, size: int, strict: bool) -> bytes:
    if strict and len(data) < size:
        raise ValueError(f"{len(data)} bytes where {size} are needed")
    return data[:size].ljust(size, b"\0")


@lru_cache(8)
def _packer(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


@lru_cache(1)
def _unpacker() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def encode(data: bytes, method: str, pixel_type: str = "Gray8", level: int = 1, hi_lo: bool = False) -> bytes:
    """A payload by "UnCompressed", "Zstd0" or "Zstd1"; hi_lo is for Zstd1 of 16-bit samples."""
    if method == "UnCompressed":
        return data
    if method not in ("Zstd0", "Zstd1"):
        raise NotImplementedError(f"no codec for {method}")
    packer = _packer(min(max(level, -131072), zstandard.MAX_COMPRESSION_LEVEL))
    if method == "Zstd0":
        return packer.compress(data)
    if hi_lo and pixel_type in ("Gray16", "Bgr48"):
        return b"\x03\x01\x01" + packer.compress(hi_lo_pack(data))
    return b"\x01" + packer.compress(data)


def decode(data: bytes, method: str, w: int, h: int, pixel_type: str = "Gray8", strict: bool = False) -> bytes:
    """The samples without padding. Short data are filled with zeros and surplus is cut, unless strict."""
    size = w * h * BYTES_PER_PIXEL[pixel_type]
    if method == "UnCompressed":
        return _sized(data, size, strict)
    if method not in ("Zstd0", "Zstd1"):
        raise NotImplementedError(f"no codec for {method}")
    at, packed = 0, False
    if method == "Zstd1":
        if data[:1] == b"\x01":
            at = 1
        elif len(data) >= 3 and data[0] == 3 and data[1] == 1:
            at, packed = 3, bool(data[2] & 1)
        else:
            raise ValueError("no header of this method")
    body = data[at:]
    known = zstandard.get_frame_parameters(body).content_size
    if known in (zstandard.CONTENTSIZE_UNKNOWN, zstandard.CONTENTSIZE_ERROR):
        raise ValueError("the frame does not state its size")
    if strict and known != size:
        raise ValueError(f"{known} bytes where {size} are needed")
    out = _unpacker().decompress(body)
    if packed:
        if pixel_type not in ("Gray16", "Bgr48"):
            raise ValueError("packed bytes need 16-bit samples")
        out = hi_lo_unpack(out)
    return _sized(out, size, False)


def _by_row(df: DataFrame, work, name: str) -> DataFrame:
    """df (sb_index, compression_raw, pixel_type, stored_w, stored_h, data) with data replaced by work(row)."""
    keys = ["sb_index", "compression_raw", "pixel_type", "stored_w", "stored_h", "data"]
    methods = {v: k for k, v in COMPRESSIONS.items()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, raw, kind, w, h, data in zip(*(batch.column(k).to_pylist() for k in keys), strict=True):
                out.append(None if data is None else work(data, methods.get(raw, "Invalid"), w, h, _NAMES.get(kind, "Invalid")))
            yield pa.RecordBatch.from_arrays([batch.column("sb_index"), pa.array(out, pa.binary())], ["sb_index", name])

    return df.select(*keys).mapInArrow(rows, f"sb_index long, {name} binary")


def decoded(df: DataFrame, strict: bool = False) -> DataFrame:
    """(sb_index, samples) of compressed payloads; a method without a codec raises."""
    return _by_row(df, lambda data, method, w, h, kind: decode(data, method, w, h, kind, strict), "samples")


def encoded(df: DataFrame, level: int = 1, hi_lo: bool = True) -> DataFrame:
    """(sb_index, packed) of plain payloads, each by its own method."""
    return _by_row(df, lambda data, method, w, h, kind: encode(data, method, kind, level, hi_lo), "packed")


def sized(data: Column, size: Column) -> Column:
    """An uncompressed payload cut or filled with zeros to a size, inside the JVM."""
    return F.rpad(data, size.cast("int"), F.lit(b"\0"))


def write_chunks(chunks: list[tuple[uuid.UUID, bytes]]) -> bytes:
    return b"".join(k.bytes_le + struct.pack("<I", len(v)) + v for k, v in chunks)


def chunks_of(data: bytes) -> list[tuple[uuid.UUID, int, int]]:
    """(guid, offset, size) of the chunks of a container; at least 21 bytes are needed, and a chunk that is cut short is an error."""
    if data is None or len(data) < 21:
        raise ValueError("not a chunk container")
    out, at = [], 0
    while len(data) >= at + 21:
        size = struct.unpack_from("<I", data, at + 16)[0]
        if len(data) < at + 20 + size:
            raise ValueError("a chunk is cut short")
        out.append((uuid.UUID(bytes_le=data[at : at + 16]), at + 20, size))
        at += 20 + size
    return out


def mask_chunk(w: int, h: int, stride: int, bits: bytes) -> bytes:
    return struct.pack("<4I", w, h, 0, stride) + bits


def mask_of(data: bytes) -> tuple[int, int, int, bytes] | None:
    """(width, height, stride, bits) of a container's mask; None for anything that is not a whole mask."""
    try:
        for guid, at, size in chunks_of(data):
            if guid == VALID_PIXELS:
                w, h, kind, stride = struct.unpack_from("<4I", data, at)
                bits = data[at + 16 : at + size]
                row = (w + 7) // 8
                good = kind == 0 and w and h and stride >= row and len(bits) >= (h - 1) * stride + row
                return (w, h, stride, bits) if good else None
    except (ValueError, struct.error):
        pass
    return None


def masks_of(attachments: DataFrame) -> DataFrame:
    """(sb_index, mask_w, mask_h, stride, bits) of the tiles' attachments (sb_index, sb_attachment) that hold a mask."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *m) for i, d in zip(batch.column("sb_index").to_pylist(), batch.column("sb_attachment").to_pylist(), strict=True) if d is not None and (m := mask_of(d))]
            columns = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["sb_index", "mask_w", "mask_h", "stride", "bits"])

    return attachments.select("sb_index", "sb_attachment").mapInArrow(rows, "sb_index long, mask_w int, mask_h int, stride int, bits binary")


class Bitonal:
    """A bitmap of one bit a pixel, the highest bit first."""

    def __init__(self, w: int, h: int, bits: np.ndarray | None = None) -> None:
        self.w, self.h = w, h
        self.bits = np.zeros((h, w), bool) if bits is None else bits

    @classmethod
    def unpacked(cls, w: int, h: int, stride: int, data: bytes) -> Bitonal:
        rows = np.frombuffer(data.ljust(h * stride, b"\0")[: h * stride], np.uint8).reshape(h, stride)
        return cls(w, h, np.unpackbits(rows, axis=1)[:, :w].astype(bool))

    def packed(self) -> bytes:
        return np.packbits(self.bits, axis=1).tobytes()

    def _inside(self, x: int, y: int) -> None:
        if not (0 <= x < self.w and 0 <= y < self.h):
            raise IndexError(f"({x}, {y}) is outside")

    def get(self, x: int, y: int) -> bool:
        self._inside(x, y)
        return bool(self.bits[y, x])

    def set(self, x: int, y: int, value: bool) -> None:
        self._inside(x, y)
        self.bits[y, x] = value

    def fill(self, x: int, y: int, w: int, h: int, value: bool) -> None:
        """Clipped to the bitmap."""
        self.bits[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)] = value

    def copy_at(self, other: Bitonal, x: int, y: int) -> None:
        x0, y0, x1, y1 = max(0, x), max(0, y), min(self.w, x + other.w), min(self.h, y + other.h)
        if x0 < x1 and y0 < y1:
            self.bits[y0:y1, x0:x1] = other.bits[y0 - y : y1 - y, x0 - x : x1 - x]

    def decimated(self, n: int) -> Bitonal:
        """Half the size: a pixel is set if all of the (2n + 1) squared pixels around its source are; outside counts as set."""
        if not 0 <= n <= 7:
            raise ValueError("a neighbourhood is 0 to 7")
        wide = np.pad(self.bits, n, constant_values=True)
        out = np.ones((self.h // 2, self.w // 2), bool)
        for dy in range(2 * n + 1):
            for dx in range(2 * n + 1):
                out &= wide[dy : dy + self.h, dx : dx + self.w][: self.h // 2 * 2 : 2, : self.w // 2 * 2 : 2]
        return Bitonal(self.w // 2, self.h // 2, out)


def decimated(pixels: DataFrame, n: int) -> DataFrame:
    """Bitonal.decimated() for many bitmaps in long form: pixels (id, w, h, x, y, on), one row each -> (id, x, y, on).

    Pixels are packed to words of 32 before they move, beside bits of what is known and of what is wanted. What is off is
    widened along x by shifts, with the words to both sides, and along y by a window of 2n + 1 rows; keys are rows and
    columns of words, never whole tables.
    """
    if not 0 <= n <= 7:
        raise ValueError("a neighbourhood is 0 to 7")
    bit, word = F.expr("shiftleft(1L, x & 31)"), F.expr("shiftright(cast(x as int), 5)")
    bits = lambda where, name: F.bit_or(F.when(where, bit).otherwise(F.lit(0).cast("long"))).alias(name)
    wanted = F.expr("x % 2 = 0 and x div 2 < w div 2 and y % 2 = 0 and y div 2 < h div 2")
    words = pixels.groupBy("id", "y", word.alias("word")).agg(bits(~F.col("on").cast("boolean"), "off"), bits(F.col("on").isNotNull(), "known"), bits(wanted, "wanted"))
    row, column = Window.partitionBy("id", "y").orderBy("word"), Window.partitionBy("id", "word").orderBy("y").rangeBetween(-n, n)
    low = (1 << n) - 1
    beside = {f"{k}_{side}": F.when(at("word") == F.col("word") + step, at(k)).otherwise(F.lit(0).cast("long")) for k in ("off", "known") for side, step, at in (("left", -1, lambda c: F.lag(c).over(row)), ("right", 1, lambda c: F.lead(c).over(row)))}
    three = lambda k: f"(shiftright({k}_left, {32 - n}) & {low}L | shiftleft({k}, {n}) | shiftleft({k}_right & {low}L, {32 + n}))"
    wide = lambda k: F.expr("(" + " | ".join(f"shiftrightunsigned({three(k)}, {d})" for d in range(2 * n + 1)) + ") & 4294967295L")
    spread_ = words.withColumns(beside).select("id", "y", "word", "wanted", wide("off").alias("off"), wide("known").alias("known"))
    near = spread_.select("id", "y", "word", "wanted", *[F.bit_or(k).over(column).alias(k) for k in ("off", "known")]).where("wanted <> 0")
    each = near.withColumn("b", F.explode(F.array(*[F.lit(b) for b in range(0, 32, 2)]))).where("shiftright(wanted, b) & 1 = 1")
    on = F.expr("case when shiftright(off, b) & 1 = 1 then false when shiftright(known, b) & 1 = 1 then true end")
    return each.select("id", F.expr("cast(word * 16 + b div 2 as int)").alias("x"), F.expr("cast(y div 2 as int)").alias("y"), on.alias("on"))
