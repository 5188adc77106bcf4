"""Queries over the tile directory: filters, statistics, orders, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import geometry as g
from tessel.functions.parsing import IndexSet
from tessel.schema import DIM_COLUMNS, DIMS, NO_LAYER, NO_SCENE, PYRAMID_TOLERANCES, Rect


def enum_subset(tiles: DataFrame, plane: dict[str, int] | None = None, roi: Rect | None = None, layer0: bool = False) -> DataFrame:
    """Tiles on the plane that overlap the region; each condition is optional, and all reach the scan."""
    if plane:
        tiles = tiles.where(g.on_plane(plane))
    if roi:
        tiles = tiles.where(g.overlaps(roi))
    return tiles.where(g.is_layer0()) if layer0 else tiles


def with_derived(tiles: DataFrame) -> DataFrame:
    """The public row of a tile: zoom, minification, and codes by name."""
    return tiles.select(
        "sb_index",
        g.coordinate_string().alias("coordinate"),
        "m_index",
        F.col("m_index").isNotNull().alias("m_valid"),
        g.zoom().alias("zoom"),
        g.minification().alias("minification"),
        g.pixel_type_name(F.col("pixel_type")).alias("pixel_type_name"),
        g.bytes_per_pixel(F.col("pixel_type")).alias("bytes_per_pixel"),
        g.compression_name(F.col("compression_raw")).alias("compression"),
        g.pyramid_type_name(F.col("pyramid_type")).alias("pyramid"),
        "file_position",
    )


def of_scenes(tiles: DataFrame, scenes: IndexSet | None) -> DataFrame:
    """Tiles without a scene pass; others must be in the set."""
    return tiles if scenes is None else tiles.where(F.col("dim_s").isNull() | scenes.column(F.col("dim_s")))


def _box(prefix: str, where: Column | None = None) -> list[Column]:
    of = lambda c: c if where is None else F.when(where, c)
    x, y = F.min(of(F.col("x"))), F.min(of(F.col("y")))
    return [
        x.alias(f"{prefix}x"),
        y.alias(f"{prefix}y"),
        (F.max(of(F.col("x") + F.col("w"))) - x).alias(f"{prefix}w"),
        (F.max(of(F.col("y") + F.col("h"))) - y).alias(f"{prefix}h"),
    ]


def statistics(tiles: DataFrame) -> DataFrame:
    """One row: count, box of all tiles and of layer 0, start and size of each dimension, range of M (of tiles that have some dimension)."""
    dims = [x for d, c in zip(DIMS, DIM_COLUMNS, strict=True) for x in (F.min(c).alias(f"{d}_start"), (F.max(c) - F.min(c) + 1).alias(f"{d}_size"))]
    m = F.when(F.coalesce(*DIM_COLUMNS).isNotNull(), F.col("m_index"))
    return tiles.agg(F.count("*").alias("n"), *_box("box_"), *_box("layer0_", g.is_layer0()), *dims, F.min(m).alias("m_min"), F.max(m).alias("m_max"))


def scene_boxes(tiles: DataFrame) -> DataFrame:
    """For each scene its number of tiles and boxes; the layer-0 box is null if the scene has no such tile."""
    return tiles.where("dim_s is not null").groupBy("dim_s").agg(F.count("*").alias("n"), *_box("box_"), *_box("layer0_", g.is_layer0()))


def dimension_bounds(tiles: DataFrame) -> DataFrame:
    """(dim, start, size) of the dimensions that occur, with their place in the order."""
    one = tiles.agg(*[F.struct(F.min(c).alias("start"), (F.max(c) - F.min(c) + 1).alias("size")).alias(d) for d, c in zip(DIMS, DIM_COLUMNS, strict=True)])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("place"), F.lit(d.upper()).alias("dim"), F.col(f"{d}.start").alias("start"), F.col(f"{d}.size").alias("size")) for i, d in enumerate(DIMS)])
    return one.select(F.inline(rows)).where("start is not null")


def bounds_string(tiles: DataFrame) -> DataFrame:
    """One row with the bounds as text, such as C0:2T0:4."""
    parts = [F.when(F.min(c).isNotNull(), F.concat(F.lit(d.upper()), F.min(c), F.lit(":"), F.max(c) - F.min(c) + 1)) for d, c in zip(DIMS, DIM_COLUMNS, strict=True)]
    return tiles.agg(F.concat_ws("", *parts).alias("bounds"))


def pyramid_layer() -> tuple[Column, Column]:
    """(factor, layer) by the table of tolerances: (0, 0) on layer 0, NO_LAYER twice if nothing fits. The table is folded into the expression, so no join is needed."""
    f = g.minification()
    factor, layer = F.when(g.is_layer0(), 0), F.when(g.is_layer0(), 0)
    for base, k, value, off in PYRAMID_TOLERANCES:
        fits = (f >= value - off) & (f <= value + off)
        factor, layer = factor.when(fits, base), layer.when(fits, k)
    return factor.otherwise(NO_LAYER), layer.otherwise(NO_LAYER)


def pyramid_statistics(tiles: DataFrame) -> DataFrame:
    """(scene, factor, layer, n, place): tiles for each scene and pyramid layer; place orders a scene's layers from fine to coarse, unidentified last."""
    factor, layer = pyramid_layer()
    counts = tiles.groupBy(F.coalesce("dim_s", F.lit(NO_SCENE)).alias("scene"), factor.alias("factor"), layer.alias("layer")).agg(F.count("*").alias("n"))
    size = F.when(F.col("layer") == 0, 0.0).when(F.col("factor") == NO_LAYER, float("inf")).otherwise(F.pow("factor", "layer"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("scene").orderBy(size, "factor")))  # a few layers a scene


def pixel_type_per_channel(tiles: DataFrame) -> DataFrame:
    """(dim_c, pixel_type): that of the first tile of each channel, those without a channel included."""
    return tiles.groupBy("dim_c").agg(F.min_by("pixel_type", "sb_index").alias("pixel_type"))


def arbitrary_in_channel(tiles: DataFrame, channel: int) -> DataFrame:
    """The first tile of the channel, or the very first where no tile has a channel."""
    first = lambda where: F.min_by(F.struct(*tiles.columns), F.when(where, F.col("sb_index")))
    one = tiles.agg(F.when(F.count("dim_c") == 0, first(F.lit(True))).otherwise(first(F.col("dim_c") == channel)).alias("t"))
    return one.where("t is not null").select("t.*")


def check_plane(tiles: DataFrame, plane: dict[str, int]) -> None:
    """Raises ValueError for a plane that composites cannot take: S is given, a dimension is out of range, missing though it varies, or unknown."""
    plane = {k.lower(): v for k, v in plane.items()}
    if "s" in plane:
        raise ValueError("S must not be given")
    found = {r["dim"].lower(): r for r in dimension_bounds(tiles).collect()}  # nine rows at most
    for d, r in found.items():
        if d == "s":
            continue
        if d not in plane:
            if r["size"] > 1:
                raise ValueError(f"dimension {d.upper()} is missing")
        elif not r["start"] <= plane[d] < r["start"] + r["size"]:
            raise ValueError(f"dimension {d.upper()} is out of range")
    if more := set(plane) - set(found):
        raise ValueError(f"dimensions not in the document: {sorted(more)}")


def plane_errors(tiles: DataFrame, planes: DataFrame) -> DataFrame:
    """planes (plane_id, dim_...) with the first error of each by the rules of check_plane(), or Ok."""
    one = tiles.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"_{c}") for c in DIM_COLUMNS])
    error = F.when(F.col("dim_s").isNotNull(), "scene given")
    for c in DIM_COLUMNS:
        if c != "dim_s":
            lo, hi, v = F.col(f"_{c}.lo"), F.col(f"_{c}.hi"), F.col(c)
            error = error.when(lo.isNotNull() & v.isNull() & (hi > lo), "missing dimension").when(lo.isNotNull() & v.isNotNull() & ((v < lo) | (v > hi)), "out of range")
    for c in DIM_COLUMNS:
        error = error.when(F.col(f"_{c}.lo").isNull() & F.col(c).isNotNull(), "surplus dimension")
    return planes.join(F.broadcast(one), how="cross").select("plane_id", error.otherwise("Ok").alias("error"))  # one row of bounds


def transformed(points: DataFrame, tiles: DataFrame, to_pixel: bool = True) -> DataFrame:
    """points (px, py) from raw coordinates to those relative to the layer-0 origin, or back; one row of origin is broadcast."""
    origin = tiles.where(g.is_layer0()).agg(F.min("x").alias("_ox"), F.min("y").alias("_oy"))
    sign = -1 if to_pixel else 1
    return points.join(F.broadcast(origin), how="cross").withColumns({"px": F.col("px") + sign * F.col("_ox"), "py": F.col("py") + sign * F.col("_oy")}).drop("_ox", "_oy")


def union_area(rects: DataFrame, roi: Rect, group: str) -> DataFrame:
    """(group, area, covered): the area of the union of each group's rectangles inside the region, and whether that is all of it.

    Each rectangle gives a row for each pixel column that it covers; intervals of a column are merged by a running
    maximum. Work grows with the widths of rectangles, and a large group is dealt out by columns.
    """
    clipped = rects.withColumns(g.intersection(roi)).where("iw > 0 and ih > 0")
    columns = clipped.select(group, F.explode(F.sequence(F.col("ix"), F.col("ix") + F.col("iw") - 1)).alias("cx"), F.col("iy").alias("lo"), (F.col("iy") + F.col("ih")).alias("hi"))
    before = Window.partitionBy(group, "cx").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo"), F.coalesce(F.max("hi").over(before), F.col("lo"))))
    area = columns.select(group, new.alias("a")).groupBy(group).agg(F.sum("a").cast("long").alias("area"))
    return area.withColumn("covered", F.col("area") == roi.w * roi.h)


def is_covered(rects: DataFrame, roi: Rect) -> bool:
    """Whether the rectangles cover the region; a region without size is covered by anything."""
    if roi.w <= 0 or roi.h <= 0:
        return True
    row = union_area(rects.withColumn("_g", F.lit(0)), roi, "_g").first()
    return bool(row and row["covered"])


def attachment_subset(attachments: DataFrame, kind: str | None = None, name: str | None = None, idx: int | None = None) -> DataFrame:
    """Attachments of that type, name and index, each optional and exact."""
    for column, value in (("content_file_type", kind), ("name", name), ("idx", idx)):
        if value is not None:
            attachments = attachments.where(F.col(column) == value)
    return attachments


def attachment_histogram(attachments: DataFrame) -> DataFrame:
    return attachments.groupBy("name").agg(F.count("*").alias("n"))


def directory_problems(entries: DataFrame) -> DataFrame:
    """(sb_index, problem) of rows that a strict reader refuses: entries (sb_index, m_size, dim_size, has_x, has_y, stored_w, stored_h, pyramid)."""
    problem = (
        F.when(~F.col("has_x") | ~F.col("has_y"), "no X or Y")
        .when((F.col("m_size") != 1) & ~F.col("pyramid"), "size of M")
        .when(F.col("dim_size") != 1, "size of a dimension")
        .when((F.col("stored_w") < 1) | (F.col("stored_h") < 1), "stored size")
    )
    return entries.select("sb_index", problem.alias("problem")).where("problem is not null")


def reconciled(directory: DataFrame, headers: DataFrame, prefer: str = "directory", ignore: bool = False) -> DataFrame:
    """The directory joined with the tiles' own headers: columns of the preferred side, and whether they differ.

    Unless ignore is set, a difference raises when the row is read, as a strict open does.
    """
    columns = [c for c in headers.columns if c != "sb_index"]
    both = directory.alias("d").join(headers.alias("h"), "sb_index")
    differs = ~F.struct(*[F.col(f"d.{c}") for c in columns]).eqNullSafe(F.struct(*[F.col(f"h.{c}") for c in columns]))
    a, b = ("d", "h") if prefer == "directory" else ("h", "d")
    out = both.select("sb_index", *[F.col(f"{a}.{c}").alias(c) for c in columns], differs.alias("differs"))
    return out if ignore else out.where(F.when(F.col("differs"), F.raise_error(F.concat(F.lit("directory and header differ: "), F.col("sb_index")))).otherwise(F.lit(True)))


def cache_statistics(tiles: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """One row (n, bytes) of what a cache of these tiles holds: samples and masks."""
    size = (F.col("stored_w") * F.col("stored_h")).cast("long") * g.bytes_per_pixel(F.col("pixel_type"))
    each = tiles.select("sb_index", size.alias("bytes"))
    if masks is not None:
        more = masks.select("sb_index", (F.ceil(F.col("mask_w") / 8) * F.col("mask_h")).alias("mask_bytes"))
        each = each.join(more, "sb_index", "left").select("sb_index", (F.col("bytes") + F.coalesce("mask_bytes", F.lit(0))).alias("bytes"))
    return each.agg(F.count("*").alias("n"), F.sum("bytes").cast("long").alias("bytes"))


def lru_survivors(accesses: DataFrame, by: str, most: int) -> DataFrame:
    """accesses (cache, sb_index, at, bytes): the tiles left in each cache whose least recent ones went until the sum of bytes is at most `most`."""
    last = accesses.groupBy(by, "sb_index").agg(F.max("at").alias("at"), F.max("bytes").alias("bytes"))
    recent = Window.partitionBy(by).orderBy(F.desc("at"), F.desc("sb_index")).rowsBetween(Window.unboundedPreceding, 0)
    return last.withColumn("held", F.sum("bytes").over(recent)).where(F.col("held") <= most)


def image_size(tiles: DataFrame) -> DataFrame:
    """(name, value): SizeX, SizeY of the box of all tiles, SizeM, and a size for each dimension."""
    s = statistics(tiles)
    rows = [("SizeX", F.col("box_w")), ("SizeY", F.col("box_h")), ("SizeM", F.col("m_max") - F.col("m_min") + 1), *[(f"Size{d.upper()}", F.col(f"{d}_size")) for d in DIMS]]
    return s.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), v.cast("int").alias("value")) for n, v in rows]))).where("value is not null")


def paint_order(layered: bool = False) -> list[Column]:
    """Tiles from bottom to top: by M, a missing one first, then by sb_index. layered: zoom comes first, and M counts on layer 0 only."""
    m = F.when(g.is_layer0(), F.col("m_index")) if layered else F.col("m_index")
    return [*([g.zoom()] if layered else []), m.asc_nulls_first(), F.col("sb_index").asc()]


def layer_candidates(tiles: DataFrame, zoom: float, by_scene: bool = False) -> DataFrame:
    """Of tiles with zoom at least zoom / 1.05, those below 1.9 times the least such zoom, for each scene or overall; in FLOAT arithmetic."""
    z = tiles.withColumn("zoom", g.zoom()).where(F.col("zoom") >= F.lit(float(_float32(zoom) / _float32(1.05))).cast("float"))
    if by_scene:
        z = z.withColumn("least", F.min("zoom").over(Window.partitionBy("dim_s")))
    else:
        z = z.join(F.broadcast(z.agg(F.min("zoom").alias("least"))), how="cross")  # one row
    return z.where(F.col("zoom") < (F.col("least") * F.lit(1.9).cast("float")).cast("float"))


def _float32(x: float):
    import numpy as np

    return np.float32(x)
