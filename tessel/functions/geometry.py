"""Column expressions over rectangles, zoom and the codes of the format."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.schema import BYTES_PER_PIXEL, COMPRESSIONS, DIM_COLUMNS, DIMS, INVALID_PIXEL_TYPE, PIXEL_TYPES, PYRAMID_TYPES, Rect


def overlaps(r: Rect) -> Column:
    """The tile and the rectangle share some area; touching edges or an empty rectangle do not."""
    wide = F.least(F.col("x") + F.col("w"), F.lit(r.x + r.w)) - F.greatest(F.col("x"), F.lit(r.x))
    high = F.least(F.col("y") + F.col("h"), F.lit(r.y + r.h)) - F.greatest(F.col("y"), F.lit(r.y))
    return (wide > 0) & (high > 0)


def intersects_with(r: Rect) -> Column:
    """The looser test on rectangles of valid size: a rectangle without width strictly inside counts."""
    if r.w < 0 or r.h < 0:
        return F.lit(False)
    inside = (F.col("x") < r.x + r.w) & (F.col("x") + F.col("w") > r.x) & (F.col("y") < r.y + r.h) & (F.col("y") + F.col("h") > r.y)
    return (F.col("w") >= 0) & (F.col("h") >= 0) & inside


def intersection(r: Rect) -> dict[str, Column]:
    """The common rectangle as four columns: of no size at the edge if they touch, (0, 0, 0, 0) if they are apart."""
    x, y = F.greatest(F.col("x"), F.lit(r.x)), F.greatest(F.col("y"), F.lit(r.y))
    x2, y2 = F.least(F.col("x") + F.col("w"), F.lit(r.x + r.w)), F.least(F.col("y") + F.col("h"), F.lit(r.y + r.h))
    meet = (x2 >= x) & (y2 >= y)
    return {n: F.when(meet, v).otherwise(0) for n, v in (("ix", x), ("iy", y), ("iw", x2 - x), ("ih", y2 - y))}


def is_layer0() -> Column:
    return (F.col("w") == F.col("stored_w")) & (F.col("h") == F.col("stored_h"))


def zoom() -> Column:
    """Stored over logical size, along the larger stored side, as FLOAT."""
    return F.when(F.col("stored_w") > F.col("stored_h"), F.col("stored_w") / F.col("w")).otherwise(F.col("stored_h") / F.col("h")).cast("float")


def minification() -> Column:
    """Logical over stored size, along the larger stored side, as DOUBLE."""
    return F.when(F.col("stored_w") > F.col("stored_h"), F.col("w") / F.col("stored_w")).otherwise(F.col("h") / F.col("stored_h"))


def on_plane(plane: dict[str, int]) -> Column:
    """Every dimension given in the plane is there and equal; the others do not matter."""
    return reduce(lambda a, b: a & b, [F.col(f"dim_{d.lower()}") == v for d, v in plane.items()], F.lit(True))


def _named(codes: dict[str, int], code: Column) -> Column:
    out = F.lit("Invalid")
    for name, k in codes.items():
        out = F.when(code == k, name).otherwise(out)
    return out


def pixel_type_name(code: Column) -> Column:
    return _named(PIXEL_TYPES, code)


def pixel_type_code(name: Column) -> Column:
    out = F.lit(INVALID_PIXEL_TYPE)
    for n, k in PIXEL_TYPES.items():
        out = F.when(name == n, k).otherwise(out)
    return out


def compression_name(raw: Column) -> Column:
    return _named(COMPRESSIONS, raw)


def pyramid_type_name(raw: Column) -> Column:
    return _named(PYRAMID_TYPES, raw)


def bytes_per_pixel(code: Column) -> Column:
    out = F.lit(None).cast("int")
    for n, k in PIXEL_TYPES.items():
        out = F.when(code == k, BYTES_PER_PIXEL[n]).otherwise(out)
    return out


def coordinate_string() -> Column:
    """Such as Z0C1, in the order of dimensions, of those that are there."""
    return F.concat_ws("", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(d.upper()), F.col(c))) for d, c in zip(DIMS, DIM_COLUMNS, strict=True)])


def coordinate_order() -> list[Column]:
    """Sort keys by which a missing dimension goes before a present one."""
    return [F.col(c).asc_nulls_first() for c in DIM_COLUMNS]


def dimension_mask() -> Column:
    """A bit for each dimension that is there: two rows have the same dimensions if their masks are equal."""
    return reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(DIM_COLUMNS)])


def compare_coordinates(a: str, b: str) -> Column:
    """-1, 0 or 1 for the rows aliased a and b, dimension by dimension; present is more than missing."""
    out = F.lit(0)
    for c in reversed(DIM_COLUMNS):
        p, q = F.col(f"{a}.{c}"), F.col(f"{b}.{c}")
        one = F.when(p.isNull() & q.isNull(), 0).when(p.isNull(), -1).when(q.isNull(), 1).otherwise(F.signum((p - q).cast("double")).cast("int"))
        out = F.when(one != 0, one).otherwise(out)
    return out


def parsed_coordinate(text: Column) -> dict[str, Column]:
    """The nine dimensions in a coordinate string, null where missing; for well-formed strings (parsing.coordinate judges others)."""
    found = lambda d: F.regexp_extract(text, rf"(?i){d}[ \t]*(?:\+[ \t]*)?(-?[ \t]*[0-9]+)", 1)
    return {c: F.translate(found(d), " \t", "").try_cast("int") for d, c in zip(DIMS, DIM_COLUMNS, strict=True)}
