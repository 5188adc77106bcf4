"""Composites of tiles: filter the directory, fetch each payload once, cut it to the windows that it touches, paint windows in order.

Tiles are pruned by plane, region, layer and scene before any payload is read. A payload row goes to a Python worker
once; what leaves it are pieces, already resampled, converted and cut to a window of the output, so that no sample is a
row and none moves that is not painted. Windows are painted by streaming their pieces in paint order: a worker holds one
window and one piece, whatever the number of tiles on it. An output is a table of windows; pixels() makes rows of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import geometry as g
from tessel.functions.bitmaps import ARRAYS, bitmap, convert
from tessel.functions.parsing import IndexSet
from tessel.operators import directory
from tessel.schema import INT_MIN, PIXEL_TYPES, Rect
from tessel.session import ship

#: Sides of a window of the output.
WINDOW = (256, 256)
_NAMES = {v: k for k, v in PIXEL_TYPES.items()}
_PIECE = "wx int, wy int, layer long, zoom double, m long, i long, px int, py int, pw int, ph int, data binary, bits binary"
_IMAGE = "wx int, wy int, x int, y int, w int, h int, data binary, painted binary"


def grid(spark: SparkSession, w: int, h: int) -> DataFrame:
    return spark.range(w * h).select((F.col("id") % w).cast("int").alias("px"), F.expr(f"cast(id div {w} as int)").alias("py"))


def _shown(tiles: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Cuts px0 to py1 to the output; tiles outside it go."""
    cut = {f"p{a}{k}": F.greatest(F.col(f"p{a}0"), F.lit(0)) if k == "0" else F.least(F.col(f"p{a}1"), F.lit(n - 1)) for a, n in zip("xy", size, strict=True) for k in "01"}
    return tiles.withColumns(cut).where("px0 <= px1 and py0 <= py1")


def copied(tiles: DataFrame, origin: tuple[int, int], size: tuple[int, int], step: int = 1) -> DataFrame:
    """Where each tile's samples fall on an output of that size, one to one, with the origin at (x - origin) / step, truncated."""
    for a, o, n in (("x", origin[0], "stored_w"), ("y", origin[1], "stored_h")):
        at = F.expr(f"({a} - {o}) div {step}").cast("int")
        tiles = tiles.withColumns({f"p{a}0": at, f"d{a}": at.cast("double"), f"f{a}": F.lit(1.0), f"s{a}": F.lit(0.0)}).withColumn(f"p{a}1", F.col(f"p{a}0") + F.col(n) - 1)
    return _shown(tiles, size)


def resized(tiles: DataFrame, roi: Rect, size: tuple[int, int]) -> DataFrame:
    """Where each tile's nearest samples fall on an output that shows the region: output pixel p takes sample (p - d) * f + s, rounded."""
    d = tiles
    for a, (o, n, stored, dn) in {"x": (roi.x, roi.w, "stored_w", size[0]), "y": (roi.y, roi.h, "stored_h", size[1])}.items():
        ext = "w" if a == "x" else "h"
        lo = F.greatest(F.col(a), F.lit(o))
        cut = F.least(F.col(a) + F.col(ext), F.lit(o + n)) - lo
        # As fractions of the tile and of the region first, then in samples and output pixels.
        d = d.withColumns({"_l": lo, "_c": cut})
        d = d.withColumns(
            {
                f"s{a}": (F.col("_l") - F.col(a)) / F.col(ext) * F.col(stored),
                f"n{a}": ((F.col("_l") + F.col("_c") - F.col(a)) / F.col(ext) - (F.col("_l") - F.col(a)) / F.col(ext)) * F.col(stored),
                f"d{a}": (F.col("_l") - o) / F.lit(n) * dn,
                f"e{a}": ((F.col("_l") + F.col("_c") - o) / F.lit(n) - (F.col("_l") - o) / F.lit(n)) * dn,
            }
        )
        s0, sn, d0, dl = (F.col(f"{k}{a}") for k in "snde")
        start, stop = F.greatest(F.floor(d0), F.lit(0)), F.least(F.floor(d0 + dl), F.lit(dn - 1))
        first, last = F.ceil((0 - s0) * dl / sn + d0), F.ceil((F.col(stored) - 1 - s0) * dl / sn + d0)
        d = d.withColumns({f"p{a}0": F.greatest(first, start).cast("int"), f"p{a}1": F.least(last, stop).cast("int"), f"f{a}": sn / dl}).drop("_l", "_c", f"n{a}", f"e{a}")
    return _shown(d, size)


def _nearest(p: np.ndarray, row: dict, a: str, n: int) -> np.ndarray:
    at = (p - row[f"d{a}"]) * row[f"f{a}"] + row[f"s{a}"]
    down = np.floor(np.maximum(at, 0))  # what is negative is cut to 0
    return np.clip(down + (at - down >= 0.5), 0, n - 1).astype(np.int64)


def _mask_bits(row: dict, sx: np.ndarray, sy: np.ndarray) -> np.ndarray | None:
    """Which samples a tile's mask lets through: those outside its extent are off; a tile without a mask is whole."""
    if row.get("mask_bits") is None:
        return None
    bits = np.frombuffer(row["mask_bits"], np.uint8, row["mask_h"] * row["mask_stride"]).reshape(-1, row["mask_stride"])
    bits = np.unpackbits(bits, axis=1)[:, : row["mask_w"]]
    on = np.zeros((row["stored_h"], row["stored_w"]), bool)
    h, w = min(row["stored_h"], bits.shape[0]), min(row["stored_w"], bits.shape[1])
    on[:h, :w] = bits[:h, :w]
    return on[np.ix_(sy, sx)]


def _cut(row: dict, target: str, window: tuple[int, int], border: bool) -> Iterator[dict]:
    """A tile's pieces, one for each window."""
    whole = None if target == "index" else bitmap(bytes(row["data"]), _NAMES[row["pixel_type"]], row["stored_w"], row["stored_h"])
    x0, x1, y0, y1 = row["px0"], row["px1"], row["py0"], row["py1"]
    for wy in range(y0 // window[1], y1 // window[1] + 1):
        for wx in range(x0 // window[0], x1 // window[0] + 1):
            xs = np.arange(max(x0, wx * window[0]), min(x1, (wx + 1) * window[0] - 1) + 1)
            ys = np.arange(max(y0, wy * window[1]), min(y1, (wy + 1) * window[1] - 1) + 1)
            sx, sy = _nearest(xs, row, "x", row["stored_w"]), _nearest(ys, row, "y", row["stored_h"])
            if whole is None:
                piece = np.full((len(ys), len(xs), 1), row["i"], np.int64)
            else:
                piece = convert(whole[np.ix_(sy, sx)], _NAMES[row["pixel_type"]], target)
            if border:
                edge = ((xs == x0) | (xs == x1))[None, :] | ((ys == y0) | (ys == y1))[:, None]
                piece = np.where(edge[:, :, None], 0, piece).astype(piece.dtype)
            on = _mask_bits(row, sx, sy)
            if on is None or on.any():
                yield {
                    "wx": wx, "wy": wy, **{k: row[k] for k in ("layer", "zoom", "m", "i")}, "px": int(xs[0]) - wx * window[0], "py": int(ys[0]) - wy * window[1], "pw": len(xs), "ph": len(ys),
                    "data": np.ascontiguousarray(piece).tobytes(), "bits": None if on is None else np.packbits(on).tobytes(),
                }


def painted(placed: DataFrame, payloads: DataFrame | None, size: tuple[int, int], target: str = "Gray8", ground=None, masks: DataFrame | None = None, border: bool = False, window: tuple[int, int] = WINDOW) -> DataFrame:
    """The windows (wx, wy, x, y, w, h, data, painted) of an output of that size and pixel type.

    placed: tiles as copied() or resized() gives them, with the paint order in layer, zoom, m and i (later is on top).
    payloads: (sb_index, data) of plain samples in each tile's own pixel type, converted while they are painted; a tile
    without a payload paints nothing. masks: (sb_index, mask_w, mask_h, stride, bits). ground: the value or the values
    of unpainted pixels; None leaves windows without a tile out. painted has a bit for each pixel. With the target
    "index" the samples are the sb_index of the tile on top, and no payload is read.
    """
    spark = ship(placed.sparkSession)
    need = ["layer", "zoom", "m", "i", "stored_w", "stored_h", "pixel_type", *[f"p{a}{k}" for a in "xy" for k in "01"], *[f"{k}{a}" for a in "xy" for k in "dfs"]]
    rows = placed.select("sb_index", *need)
    if masks is not None:
        rows = rows.join(masks.select("sb_index", "mask_w", "mask_h", F.col("stride").alias("mask_stride"), F.col("bits").alias("mask_bits")), "sb_index", "left")
    if target != "index":
        rows = rows.join(payloads.select("sb_index", "data"), "sb_index")
    kinds = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in _PIECE.split(", "))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                pieces = list(_cut(batch.slice(k, 1).to_pylist()[0], target, window, border))
                for j in range(0, len(pieces), 64):
                    yield pa.RecordBatch.from_pylist(pieces[j : j + 64], kinds)

    pieces = rows.mapInArrow(cut, _PIECE)
    if ground is not None:
        every = grid(spark, -(-size[0] // window[0]), -(-size[1] // window[1]))
        none = [F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in _PIECE.split(", ")[2:])]
        pieces = pieces.unionByName(every.select(F.col("px").alias("wx"), F.col("py").alias("wy"), *none))
    ordered = pieces.repartition("wx", "wy").sortWithinPartitions("wx", "wy", "layer", "zoom", "m", "i")
    kind, samples = ARRAYS[target]
    image = pa.schema([(n, {"int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in _IMAGE.split(", "))])

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, on = None, None, None

        def done() -> pa.RecordBatch:
            (wx, wy), (h, w) = at, on.shape
            row = {"wx": wx, "wy": wy, "x": wx * window[0], "y": wy * window[1], "w": w, "h": h, "data": held.tobytes(), "painted": np.packbits(on).tobytes()}
            return pa.RecordBatch.from_pylist([row], image)

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if (row["wx"], row["wy"]) != at:
                    if at:
                        yield done()
                    at = row["wx"], row["wy"]
                    w, h = (min(n, s - c * n) for n, s, c in zip(window, size, at, strict=True))
                    held, on = np.zeros((h, w, samples), kind), np.zeros((h, w), bool)
                    if ground is not None:
                        held[:] = ground
                if row["data"] is None:
                    continue
                x, y, w, h = row["px"], row["py"], row["pw"], row["ph"]
                piece = np.frombuffer(row["data"], kind).reshape(h, w, samples)
                if row["bits"] is None:
                    held[y : y + h, x : x + w], on[y : y + h, x : x + w] = piece, True
                else:
                    through = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=w * h).reshape(h, w).astype(bool)
                    held[y : y + h, x : x + w][through] = piece[through]
                    on[y : y + h, x : x + w] |= through
        if at:
            yield done()

    return ordered.mapInArrow(paint, _IMAGE)


def pixels(image: DataFrame, target: str = "Gray8", bare: bool = False, inside: bool = False) -> DataFrame:
    """(px, py, v), or (px, py, b, g, r[, a]) of a colour image. bare: only painted pixels. inside: (wx, wy) too, px and py counting inside the window."""
    kind, samples = ARRAYS[target]
    names = ["v"] if samples == 1 else ["b", "g", "r", "a"][:samples]
    integral = np.issubdtype(kind, np.integer)
    spark_kind, arrow_kind = ("long", pa.int64()) if target == "index" else ("int", pa.int32()) if integral else ("float", pa.float32())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                on = np.unpackbits(np.frombuffer(r["painted"], np.uint8), count=r["w"] * r["h"]).astype(bool)
                at = np.flatnonzero(on) if bare else np.arange(len(on))
                values = np.frombuffer(r["data"], kind).reshape(-1, samples)[at]
                place = [at % r["w"] + (0 if inside else r["x"]), at // r["w"] + (0 if inside else r["y"])]
                window = [np.full(len(at), r["wx"]), np.full(len(at), r["wy"])] if inside else []
                columns = [pa.array(c.astype(np.int32)) for c in (*window, *place)] + [pa.array(values[:, j], arrow_kind) for j in range(samples)]
                yield pa.RecordBatch.from_arrays(columns, [*(["wx", "wy"] if inside else []), "px", "py", *names])

    where = "wx int, wy int, px int, py int" if inside else "px int, py int"
    return image.mapInArrow(rows, f"{where}, " + ", ".join(f"{n} {spark_kind}" for n in names))


def ranked(tiles: DataFrame, layer: Column | None = None, zoom: Column | None = None, m: Column | None = None) -> DataFrame:
    """tiles with the paint order in layer, zoom, m and i: by M, tiles without one first, then by sb_index."""
    least = F.coalesce("m_index", F.lit(INT_MIN)).cast("long")
    order = {"layer": (F.lit(0) if layer is None else layer).cast("long"), "zoom": (F.lit(0) if zoom is None else zoom).cast("double"), "m": least if m is None else m.cast("long"), "i": F.col("sb_index").cast("long")}
    return tiles.withColumns(order)


def background(red: float, green: float, blue: float, target: str = "Gray8"):
    """The samples of a background colour of fractions; NaN means none. An alpha is whole."""
    if any(np.isnan(c) for c in (red, green, blue)):
        return None
    kind, samples = ARRAYS[target]
    if samples == 1 and kind is np.float32:
        return np.float32(np.float32(np.float32(red) + np.float32(green) + np.float32(blue)) / np.float32(3))
    most = np.iinfo(kind).max
    whole = lambda c: int(min(max(np.float32(c) + np.float32(0.5), 0), most))
    if samples == 1:
        return whole(np.float32(np.float32(most) * (np.float32(red) + np.float32(green) + np.float32(blue))) / np.float32(3))
    return [whole(np.float32(most) * np.float32(c)) for c in (blue, green, red)] + [255] * (samples - 3)


def tile_composite(tiles: DataFrame, payloads: DataFrame, plane: dict[str, int], roi: Rect, ground=0, border: bool = False, masks: DataFrame | None = None, target: str = "Gray8", window: tuple[int, int] = WINDOW) -> DataFrame:
    """The windows of layer 0 of the plane inside the region. A scene filter does not apply here. border: the clipped tile's edge is drawn as 0."""
    chosen = ranked(directory.enum_subset(tiles, plane, roi, layer0=True))
    return painted(copied(chosen, (roi.x, roi.y), (roi.w, roi.h)), payloads, (roi.w, roi.h), target, ground, masks, border, window)


def ordered_composite(tiles: DataFrame, payloads: DataFrame, roi: Rect, order: str, ground=0, border: bool = False, masks: DataFrame | None = None, target: str = "Gray8") -> DataFrame:
    """The windows of tiles that the caller chose, painted in the order of a column of numbers, at their places one to one."""
    chosen = ranked(tiles.where(g.overlaps(roi)), layer=F.col(order), m=F.lit(0))
    return painted(copied(chosen, (roi.x, roi.y), (roi.w, roi.h)), payloads, (roi.w, roi.h), target, ground, masks, border)


def visible_tiles(tiles: DataFrame, plane: dict[str, int], roi: Rect, masks: DataFrame | None = None) -> DataFrame:
    """(sb_index, pixels): the tiles that win some pixel of the region, by geometry alone, or after masking if masks are given. No payload is read."""
    chosen = ranked(directory.enum_subset(tiles, plane, roi, layer0=True))
    top = painted(copied(chosen, (roi.x, roi.y), (roi.w, roi.h)), None, (roi.w, roi.h), "index", masks=masks)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                on = np.unpackbits(np.frombuffer(r["painted"], np.uint8), count=r["w"] * r["h"]).astype(bool)
                ids, n = np.unique(np.frombuffer(r["data"], np.int64)[on], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n, pa.int64())], ["sb_index", "n"])

    return top.mapInArrow(rows, "sb_index long, n long").groupBy("sb_index").agg(F.sum("n").alias("pixels"))


def pyramid_layer_number(factor: int, layers: int = 31) -> Column:
    """The least k with factor ** k at least the rounded minification."""
    if factor < 2:
        raise ValueError("a pyramid's factor is 2 or more")
    n = F.round(g.minification())
    out, k, f = F.when(n <= 1, 0), 1, factor
    while f < 2**31 and k < layers:
        out = out.when(n <= f, k)
        f, k = f * factor, k + 1
    return out.otherwise(k)


def pyramid_composite(tiles: DataFrame, payloads: DataFrame, plane: dict[str, int], roi: Rect, factor: int, layer: int, ground=0, scenes: IndexSet | None = None, strict: bool = False, masks: DataFrame | None = None, target: str = "Gray8") -> DataFrame:
    """The windows of one pyramid layer of the plane, the region given in pixels of layer 0. strict: an error if the region has tiles but none on the layer."""
    p = factor**layer
    size = (roi.w // p, roi.h // p)
    near = directory.of_scenes(directory.enum_subset(tiles, plane, Rect(roi.x, roi.y, size[0] * p, size[1] * p)), scenes)
    chosen = near.where(pyramid_layer_number(factor) == layer)
    if strict and chosen.isEmpty() and not near.isEmpty():
        raise LookupError(f"no tile of layer {layer} in the region")
    return painted(copied(ranked(chosen), (roi.x, roi.y), size, p), payloads, size, target, ground, masks)


def zoomed_size(roi: Rect, zoom: float) -> tuple[int, int]:
    z = np.float32(zoom)
    return int(np.float32(roi.w) * z), int(np.float32(roi.h) * z)


def involved_scenes(tiles: DataFrame, roi: Rect, scenes: IndexSet | None = None) -> DataFrame:
    """(dim_s): scenes of the set whose box over all layers meets the region."""
    boxes = directory.scene_boxes(tiles).selectExpr("dim_s", "box_x as x", "box_y as y", "box_w as w", "box_h as h").where(g.intersects_with(roi))
    return directory.of_scenes(boxes, scenes).select("dim_s")


def scaling_candidates(tiles: DataFrame, plane: dict[str, int], roi: Rect, zoom: float, scenes: IndexSet | None = None) -> DataFrame:
    """The tiles that a scaled composite paints, with their zoom and scene rank.

    With one involved scene or none, tiles without a scene and of that scene are one set; with more, each scene chooses
    its own layer, and tiles without a scene are left out.
    """
    found = [r[0] for r in involved_scenes(tiles, roi, scenes).collect()]  # one number for each scene
    near = directory.enum_subset(tiles, plane, roi)
    if len(found) <= 1:
        near = near.where(F.col("dim_s").isNull() | F.col("dim_s").isin(found) if found else F.col("dim_s").isNull())
        return directory.layer_candidates(near, zoom).withColumn("scene_rank", F.lit(0))
    return directory.layer_candidates(near.where(F.col("dim_s").isin(found)), zoom, by_scene=True).withColumn("scene_rank", F.col("dim_s"))


def scaling_composite(tiles: DataFrame, payloads: DataFrame, plane: dict[str, int], roi: Rect, zoom: float, ground=0, scenes: IndexSet | None = None, masks: DataFrame | None = None, target: str = "Gray8") -> DataFrame:
    """The windows of the region at a zoom, from the pyramid layer that fits, scenes in ascending order over each other. Borders are never drawn."""
    size = zoomed_size(roi, zoom)
    chosen = scaling_candidates(tiles, plane, roi, zoom, scenes)
    m = F.when(g.is_layer0(), F.coalesce("m_index", F.lit(INT_MIN))).otherwise(INT_MIN)
    chosen = ranked(chosen, layer=F.col("scene_rank"), zoom=F.col("zoom"), m=m)
    placed = copied(chosen, (roi.x, roi.y), size) if zoom == 1 else resized(chosen, roi, size)
    return painted(placed, payloads, size, target, ground, masks)


def plane_scan(tiles: DataFrame, payloads: DataFrame, plane: dict[str, int], roi: Rect, window: tuple[int, int], target: str = "Gray8", ground=None) -> DataFrame:
    """The region in windows of that size, those at the right and bottom clipped. All come from one job; a window is a key, so neither a loop nor a range join is needed."""
    return tile_composite(tiles, payloads, plane, roi, ground, target=target, window=window)


def windows(spark: SparkSession, roi: Rect, window: tuple[int, int]) -> DataFrame:
    """(tile_x, tile_y, x, y, w, h) of the windows of a scan."""
    w, h = window
    nx, ny = -(-roi.w // w), -(-roi.h // h)
    cells = grid(spark, nx, ny).toDF("tile_x", "tile_y")
    return cells.select("tile_x", "tile_y", (F.col("tile_x") * w + roi.x).alias("x"), (F.col("tile_y") * h + roi.y).alias("y"), F.least(F.lit(w), F.lit(roi.w) - F.col("tile_x") * w).alias("w"), F.least(F.lit(h), F.lit(roi.h) - F.col("tile_y") * h).alias("h"))


#: Rows of a task whose equal regions are joined as one, which bounds what such a row holds.
_ALIKE = 1 << 18


def tiles_of_regions(tiles: DataFrame, rois: DataFrame, cell: int = 512) -> DataFrame:
    """(roi_id, sb_index): tiles that overlap each of many regions (roi_id, rx, ry, rw, rh), by an equi-join on grid cells.

    A pair is kept in the cell that holds the corner of the common area, so no pass to remove repeats is needed. Regions
    with the same rectangle are compared with a tile once, and their pairs written out after that: the pairs are as many
    as the regions and tiles make them, but comparing costs no more than the distinct rectangles. Cells are dealt in
    quarters of their sides, over all cores.
    """
    cell = max(cell // 4, 1)
    span = lambda a, n: F.sequence(F.floor(a / cell), F.floor((a + n - 1) / cell))
    tasks = 16 * tiles.sparkSession.sparkContext.defaultParallelism
    cut = lambda d, x, y, w, h: d.withColumn("cx", F.explode(span(F.col(x), F.col(w)))).withColumn("cy", F.explode(span(F.col(y), F.col(h)))).repartition(tasks, "cx", "cy")
    a = cut(tiles.select("sb_index", "x", "y", "w", "h").where("w > 0 and h > 0"), "x", "y", "w", "h")
    some = F.expr(f"monotonically_increasing_id() div {_ALIKE}").alias("some")
    alike = rois.where("rw > 0 and rh > 0").select("roi_id", "rx", "ry", "rw", "rh", some).groupBy("rx", "ry", "rw", "rh", "some").agg(F.collect_list(F.struct("roi_id")).alias("ids"))
    b = cut(alike, "rx", "ry", "rw", "rh")
    common = "least(x + w, rx + rw) > greatest(x, rx) and least(y + h, ry + rh) > greatest(y, ry)"
    corner = f"cx = floor(greatest(x, rx) / {cell}) and cy = floor(greatest(y, ry) / {cell})"
    pairs = a.join(b, ["cx", "cy"]).where(f"{common} and {corner}").select("ids", "sb_index")
    return pairs.select(F.explode("ids").alias("id"), "sb_index").select("id.roi_id", "sb_index")


def bitmap_md5(payloads: DataFrame) -> DataFrame:
    """(sb_index, md5) of packed samples, which have no padding."""
    return payloads.select("sb_index", F.md5("data").alias("md5"))


def composite_md5(image: DataFrame, target: str = "Gray8") -> DataFrame:
    """One row: the MD5 of the MD5s of the image's lines, in hexadecimal and one after the other. A task holds a line at most."""
    kind, samples = ARRAYS[target]
    size = np.dtype(kind).itemsize * samples

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                parts = [r["data"][y * r["w"] * size : (y + 1) * r["w"] * size] for y in range(r["h"])]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(r["h"], dtype=np.int32) + np.int32(r["y"])), pa.array(np.full(r["h"], r["wx"], np.int32)), pa.array(parts, pa.binary())], ["py", "wx", "data"])

    parts = image.mapInArrow(lines, "py int, wx int, data binary").groupBy("py").agg(F.sort_array(F.collect_list(F.struct("wx", F.hex("data").alias("data")))).alias("parts"))
    line = parts.select("py", F.md5(F.unhex(F.array_join("parts.data", ""))).alias("line"))
    return line.agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("py", "line"))), lambda r: r["line"]), "")).alias("md5"))  # 36 bytes for each line
