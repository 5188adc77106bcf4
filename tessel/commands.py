"""Commands over container files: information, tiles, composites, attachments, scans and new documents.

    python -m tessel.commands info FILES --levels Statistics,DisplaySettings
    python -m tessel.commands tile FILES --plane C0T3 --roi "rel(0,0,512,512)" --out file:///pictures

Each command is a function that takes the session and returns a table, so that it may be used from code as well.
Pictures are written by the executors, a PNG for each window of the output.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tessel
from tessel.functions import codecs, metadata, parsing
from tessel.functions.luts import from_gamma, from_spline, spline
from tessel.functions.png import png
from tessel.operators import channels, directory, mutations, painter
from tessel.schema import DIMS, PIXEL_TYPES, Rect
from tessel.sources import container

_NAMES = {v: k for k, v in PIXEL_TYPES.items()}
#: What info() can tell.
LEVELS = ("Statistics", "RawXml", "DisplaySettings", "DisplaySettingsJson", "AllSubBlocks", "AttachmentInfo", "AllAttachments", "PyramidStatistics", "General", "Scaling")


def version() -> tuple[int, int, int]:
    return tuple(int(x) for x in tessel.__version__.split("."))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return container.opened(spark, path, "metadata").withColumnRenamed("doc", "doc_id")


def info(spark: SparkSession, path: str, level: str) -> DataFrame:
    """A table for a level of information about the files at a path."""
    tiles = lambda: container.opened(spark, path)
    if level == "Statistics":
        return directory.statistics(tiles())
    if level == "RawXml":
        return _documents(spark, path)
    if level == "DisplaySettings":
        return metadata.display_settings(_documents(spark, path))
    if level == "DisplaySettingsJson":
        s = metadata.display_settings(_documents(spark, path))
        tint = F.when(F.col("tint_r").isNull(), "none").otherwise(F.format_string("#%02X%02X%02X", "tint_r", "tint_g", "tint_b"))
        gamma, points = F.when(F.col("mode") == "Gamma", F.col("gamma")), F.when(F.col("mode") == "Spline", F.col("points"))
        each = F.struct(F.col("channel").alias("ch"), F.col("black").alias("black-point"), F.col("white").alias("white-point"), "weight", tint.alias("tinting"), gamma.alias("gamma"), points.alias("splinelut"))
        held = s.where("enabled").groupBy("doc_id").agg(F.sort_array(F.collect_list(each)).alias("channels"))  # a document's few channels
        return held.select("doc_id", F.to_json(F.struct("channels")).alias("json"))
    if level == "AllSubBlocks":
        return directory.with_derived(tiles())
    if level == "AttachmentInfo":
        return directory.attachment_histogram(container.opened(spark, path, "attachments"))
    if level == "AllAttachments":
        return container.opened(spark, path, "attachments").drop("data")
    if level == "PyramidStatistics":
        return directory.pyramid_statistics(tiles())
    if level == "General":
        return metadata.document_info(_documents(spark, path))
    if level == "Scaling":
        return metadata.scaling(_documents(spark, path))
    raise ValueError(f"no level {level!r}; there are {', '.join(LEVELS)}")


def statistics_json(tiles: DataFrame) -> DataFrame:
    """One row (json): the statistics of a directory, and with them each scene's boxes."""
    box = lambda p: F.struct(*[F.col(f"{p}{k}").alias(k) for k in "xywh"])
    dims = F.struct(*[F.when(F.col(f"{d}_start").isNotNull(), F.struct(F.col(f"{d}_start").alias("start"), F.col(f"{d}_size").alias("size"))).alias(d.upper()) for d in DIMS])
    scenes = directory.scene_boxes(tiles).select(F.struct(F.col("dim_s").alias("sceneIndex"), box("box_").alias("boundingBox"), box("layer0_").alias("boundingBoxLayer0")).alias("s"))
    scenes = scenes.agg(F.sort_array(F.collect_list("s")).alias("scenes"))  # a row for each scene
    one = directory.statistics(tiles).crossJoin(scenes)  # a row each
    return one.select(F.to_json(F.struct(F.col("n").alias("subBlockCount"), box("box_").alias("boundingBox"), box("layer0_").alias("boundingBoxLayer0"), dims.alias("dimBounds"), F.struct(F.col("m_min").alias("min"), F.col("m_max").alias("max")).alias("mIndex"), "scenes")).alias("json"))


def dimensions_json(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, json): the dimensions that a document's metadata state."""
    each = metadata.dimension_info(_documents(spark, path))
    held = each.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("dim", "start", "end", "start_given", "end_given"))).alias("dimensions"))  # at most nine
    return held.select("doc_id", F.to_json(F.struct("dimensions")).alias("json"))


def _tiles(spark: SparkSession, path: str, plane: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """The directory and the decoded payloads of the plane; the files are one picture, whose tiles are numbered over all of them."""
    number = F.struct("doc", "sb_index")
    whole = container.opened(spark, path, "tiles", plane).withColumn("sb_index", F.xxhash64(number))
    held = whole.select("sb_index", "compression_raw", "pixel_type", "stored_w", "stored_h", "data")
    plain = held.where("compression_raw = 0").select("sb_index", "data")
    packed = codecs.decoded(held.where("compression_raw <> 0")).select("sb_index", F.col("samples").alias("data"))
    tiles = container.opened(spark, path).withColumn("sb_index", F.xxhash64(number))
    return tiles, plain.unionByName(packed)


def plane_of(text: str) -> dict[str, int]:
    """{"c": 0, "t": 3} of "C0T3"."""
    return {d: v for d, v in parsing.coordinate(text).items() if v is not None}


def _roi(tiles: DataFrame, text: str | None) -> Rect:
    """The region of a text; rel() counts from the corner of all tiles, and without a text it is all of them."""
    s = directory.statistics(tiles).first()
    return parsing.roi(text, (s["box_x"], s["box_y"])) if text else Rect(s["box_x"], s["box_y"], s["box_w"], s["box_h"])


def tile(spark: SparkSession, path: str, plane: str, roi: str | None = None, kind: str = "Gray8", background: tuple[float, float, float] = (0, 0, 0), border: bool = False) -> DataFrame:
    """The windows of layer 0 of a plane."""
    tiles, data = _tiles(spark, path, plane_of(plane))
    return painter.tile_composite(tiles, data, plane_of(plane), _roi(tiles, roi), painter.background(*background, kind), border, target=kind)


def pyramid(spark: SparkSession, path: str, plane: str, roi: str | None, factor: int, layer: int, kind: str = "Gray8", background: tuple[float, float, float] = (0, 0, 0), scenes: str | None = None) -> DataFrame:
    """The windows of a pyramid layer of a plane."""
    tiles, data = _tiles(spark, path, plane_of(plane))
    return painter.pyramid_composite(tiles, data, plane_of(plane), _roi(tiles, roi), factor, layer, painter.background(*background, kind), parsing.IndexSet(scenes) if scenes else None, target=kind)


def scaled(spark: SparkSession, path: str, plane: str, roi: str | None, zoom: float, kind: str = "Gray8", background: tuple[float, float, float] = (0, 0, 0), scenes: str | None = None) -> DataFrame:
    """The windows of a plane at a zoom."""
    tiles, data = _tiles(spark, path, plane_of(plane))
    return painter.scaling_composite(tiles, data, plane_of(plane), _roi(tiles, roi), zoom, painter.background(*background, kind), parsing.IndexSet(scenes) if scenes else None, target=kind)


def settings(text: str, bits: int = 8) -> list[channels.Channel]:
    """Channels of {"channels": [{"ch", "black-point", "white-point", "weight", "tinting", "gamma", "splinelut"}]}."""
    held = json.loads(text)
    if not isinstance(held.get("channels"), list):
        raise ValueError("no list of channels")
    out = []
    for c in held["channels"]:
        if not isinstance(c.get("ch"), int):
            raise ValueError("a channel without a number")
        tint = (c.get("tinting") or "none").strip()
        rgb = None if tint.lower() == "none" else parsing.colour("#FF" + tint.lstrip("#")[-6:])
        if tint.lower() != "none" and rgb is None:
            raise ValueError(f"not a colour: {tint!r}")
        black, white = float(c.get("black-point", 0)), float(c.get("white-point", 1))
        lut: list[int] = []
        if points := c.get("splinelut"):
            lut = from_spline(2**bits, black, white, spline(list(zip(points[::2], points[1::2], strict=True))))
        elif c.get("gamma") is not None:
            lut = from_gamma(2**bits, black, white, float(c["gamma"]))
        out.append(channels.Channel(c["ch"], float(c.get("weight", 1)), rgb, black, white, tuple(lut)))
    return out


def composed(spark: SparkSession, path: str, plane: str, roi: str | None = None, zoom: float | None = None, shown: str | None = None, fmt: str = "bgr24", scenes: str | None = None) -> DataFrame:
    """(px, py, b, g, r[, a]): the channels of a plane as display settings show them, those of the first document or of a JSON text, at a zoom or one to one."""
    wanted = settings(shown) if shown else metadata.active_channels(metadata.display_settings(_documents(spark, path).limit(1)))
    kinds = {r["dim_c"]: _NAMES[r["pixel_type"]] for r in directory.pixel_type_per_channel(container.opened(spark, path)).collect()}  # a row for each channel
    out = None
    for c in wanted:
        one, kind = {**plane_of(plane), "c": c.index}, kinds[c.index]
        tiles, data = _tiles(spark, path, one)
        area, none = _roi(tiles, roi), parsing.IndexSet(scenes) if scenes else None
        image = painter.tile_composite(tiles, data, one, area, 0, target=kind) if zoom is None else painter.scaling_composite(tiles, data, one, area, zoom, 0, none, target=kind)
        rows = painter.pixels(image, kind)
        rows = rows.select(F.lit(c.index).alias("channel"), "px", "py", F.array("b", "g", "r").alias("v") if kind.startswith("Bgr") else F.array("v").alias("v"))
        out = rows if out is None else out.unionByName(rows)
    name, alpha = parsing.channel_format(fmt)
    return channels.composed(out, wanted, kinds=kinds, alpha=alpha if name == "bgra32" else None)


def subblock(spark: SparkSession, path: str, index: int) -> DataFrame:
    """The tile of that number in each file, its payload decoded, with its digest."""
    held = container.opened(spark, path, "tiles").where(F.col("sb_index") == index).withColumn("sb_index", F.xxhash64("doc"))  # one of each file
    packed = codecs.decoded(held.where("compression_raw <> 0").select("sb_index", "compression_raw", "pixel_type", "stored_w", "stored_h", "data")).select("sb_index", F.col("samples").alias("data"))
    plain = held.where("compression_raw = 0").select("sb_index", "data").unionByName(packed)
    return held.drop("data").join(plain, "sb_index").withColumns({"sb_index": F.lit(index).cast("long"), "md5": F.md5("data")})


def attachment(spark: SparkSession, path: str, name: str | None = None, kind: str | None = None) -> DataFrame:
    """Attachments by name and type, with their contents."""
    return directory.attachment_subset(container.opened(spark, path, "attachments"), name=name, kind=kind)


def create(spark: SparkSession, folder: str, name: str, bounds: str, mosaic: str, size: tuple[int, int], compression: str = "Zstd1:") -> DataFrame:
    """Writes a document of mosaics of grey tiles, each of one value, at every coordinate of the bounds; returns its directory."""
    rows, columns, overlap = parsing.mosaic(mosaic)
    t = mutations.synthetic_document(container.registered(spark), parsing.bounds(bounds), rows, columns, size, overlap)
    method, options = parsing.compression_options(compression)
    w, h = size
    value = F.lpad(F.hex(F.col("sb_index") % 256), 2, "0")
    t = t.withColumns({"data": F.unhex(F.repeat(value, w * h)), "compression_raw": F.lit(method)})
    packed = t.select("sb_index", "data") if method == 0 else codecs.encoded(t, level=options.get("level", 1)).select("sb_index", F.col("packed").alias("data"))
    out = t.drop("data").join(packed, "sb_index").withColumn("doc", F.lit(name))
    out.repartition("doc").sortWithinPartitions("doc", "sb_index").write.format("tile_container").mode("append").save(folder)
    return t.drop("data")


def scan(spark: SparkSession, path: str, plane: str, roi: str | None, window: tuple[int, int], kind: str = "Gray8") -> DataFrame:
    """A plane in windows of that size."""
    tiles, data = _tiles(spark, path, plane_of(plane))
    return painter.plane_scan(tiles, data, plane_of(plane), _roi(tiles, roi), window, kind, ground=0)


def save(image: DataFrame, folder: str, kind: str) -> DataFrame:
    """(file, bytes): a PNG for each window, window_X_Y.png, written by the tasks. Written again, a file is the same."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path)
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                data = png(r["data"], r["w"], r["h"], kind)
                name = f"window_{r['wx']}_{r['wy']}.png"
                with fs.open_output_stream(f"{path}/{name}") as f:
                    f.write(data)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(data)], pa.int64())], ["file", "bytes"])

    return image.mapInArrow(rows, "file string, bytes long")


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessel", description=__doc__.split("\n")[0])
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple[str, dict], source: bool = True):
        c = commands.add_parser(name)
        c.add_argument("path" if source else "folder")
        for flag, more in options:
            c.add_argument(flag, **more)

    plane, roi, kind, out = ("--plane", {"default": ""}), ("--roi", {}), ("--kind", {"default": "Gray8"}), ("--out", {"required": True})
    back, scenes, zoom, shown = ("--background", {"default": "0/0/0"}), ("--scenes", {}), ("--zoom", {"type": float, "required": True}), ("--display", {})
    commands.add_parser("version")
    command("info", ("--levels", {"default": "Statistics"}))
    command("subblock", ("--index", {"type": int, "required": True}))
    command("tile", plane, roi, kind, back, out, ("--border", {"action": "store_true"}))
    command("pyramid", plane, roi, kind, back, out, scenes, ("--factor", {"type": int, "default": 2}), ("--layer", {"type": int, "required": True}))
    command("scaled", plane, roi, kind, back, out, scenes, zoom)
    command("channels", plane, roi, shown, ("--format", {"default": "bgr24"}), ("--out", {"required": True}))
    command("scaled-channels", plane, roi, shown, scenes, zoom, ("--format", {"default": "bgr24"}), ("--out", {"required": True}))
    command("attachment", ("--name", {}), ("--kind", {}))
    command("create", ("--name", {"default": "new"}), ("--bounds", {"required": True}), ("--mosaic", {"default": "1x1"}), ("--size", {"default": "256x256"}), ("--compression", {"default": "Zstd1:"}), source=False)
    command("scan", plane, roi, kind, out, ("--window", {"default": "512x512"}))
    a = p.parse_args(arguments)
    if a.command == "version":
        print(tessel.__version__)
        return
    spark = SparkSession.builder.getOrCreate()
    pair = lambda text: tuple(int(x) for x in text.lower().split("x"))
    colour = lambda text: tuple(float(x) for x in text.split("/"))
    if a.command == "info":
        for level in a.levels.split(","):
            print(level)
            info(spark, a.path, level.strip()).show(1000, truncate=False)
    elif a.command == "subblock":
        subblock(spark, a.path, a.index).drop("data").show(truncate=False)
    elif a.command == "attachment":
        attachment(spark, a.path, a.name, a.kind).show(truncate=False)
    elif a.command == "create":
        create(spark, a.folder, a.name, a.bounds, a.mosaic, pair(a.size), a.compression).show()
    elif a.command in ("channels", "scaled-channels"):
        composed(spark, a.path, a.plane, a.roi, getattr(a, "zoom", None), a.display, a.format, getattr(a, "scenes", None)).write.parquet(a.out)
    else:
        if a.command == "tile":
            image = tile(spark, a.path, a.plane, a.roi, a.kind, colour(a.background), a.border)
        elif a.command == "pyramid":
            image = pyramid(spark, a.path, a.plane, a.roi, a.factor, a.layer, a.kind, colour(a.background), a.scenes)
        elif a.command == "scaled":
            image = scaled(spark, a.path, a.plane, a.roi, a.zoom, a.kind, colour(a.background), a.scenes)
        else:
            image = scan(spark, a.path, a.plane, a.roi, pair(a.window), a.kind)
        save(image, a.out, a.kind).show(1000, truncate=False)


if __name__ == "__main__":
    main()
