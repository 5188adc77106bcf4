"""Keyed inserts, updates and deletes of tiles and attachments, as joins that give the new table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions import geometry as g
from tessel.schema import DIM_COLUMNS, DIMS

#: Steps of zoom that count as one; a tolerance between pairs would not be transitive.
ZOOM_STEP = 1e-4


def zoom_key() -> Column:
    return F.round(g.zoom().cast("double") / ZOOM_STEP).cast("long")


def _writer_keys() -> list[Column]:
    valid = F.col("m_index").isNotNull()
    place = lambda c: F.when(~valid, F.col(c))
    return [zoom_key().alias("_zoom"), *[F.col(c) for c in DIM_COLUMNS], F.col("m_index"), place("x").alias("_x"), place("y").alias("_y")]


def writer_order(tiles: DataFrame) -> DataFrame:
    """(sb_index, zoom_key, dim_..., place): the order of a written directory is zoom_key descending, coordinate ascending, place ascending.

    place numbers the tiles of one zoom and coordinate: by M, a missing one last, then by position, then as they came.
    A directory is sorted in parallel by these columns; no window holds more than a plane.
    """
    valid = F.col("m_index").isNotNull()
    within = Window.partitionBy("zoom_key", *DIM_COLUMNS).orderBy(F.col("m_index").asc_nulls_last(), F.when(~valid, F.col("x")), F.when(~valid, F.col("y")), "file_position", "sb_index")
    return tiles.withColumn("zoom_key", zoom_key()).select("sb_index", "zoom_key", *DIM_COLUMNS, F.row_number().over(within).alias("place"))


def writer_duplicates(tiles: DataFrame) -> DataFrame:
    """(sb_index, kept_index): tiles that a writer refuses, since an earlier one has the same zoom, coordinate and M, or position without M."""
    same = Window.partitionBy(*_writer_keys())
    return tiles.withColumn("kept_index", F.min("sb_index").over(same)).where("sb_index > kept_index").select("sb_index", "kept_index")


def unique_tiles(tiles: DataFrame) -> DataFrame:
    """The tiles that a writer takes, one after the other."""
    return tiles.join(writer_duplicates(tiles).select("sb_index"), "sb_index", "left_anti")


def updater_clashes(held: DataFrame, new: DataFrame) -> DataFrame:
    """New tiles that an update in place refuses: a held one has the same coordinate and a valid equal M, both on layer 0."""
    one = held.where(g.is_layer0() & F.col("m_index").isNotNull()).select(*DIM_COLUMNS, "m_index").distinct()
    fits = g.is_layer0() & F.col("m_index").isNotNull()
    same = reduce(lambda a, b: a & b, [F.col(f"n.{c}").eqNullSafe(F.col(f"h.{c}")) for c in (*DIM_COLUMNS, "m_index")])
    return new.where(fits).alias("n").join(one.alias("h"), same, "left_semi").select("sb_index")


def bounds_check(tiles: DataFrame, bounds: dict[str, tuple[int, int]] | None, m: tuple[int, int] | None = None) -> DataFrame:
    """(sb_index, result): Ok, OutOfBounds, Insufficient or Unexpected against declared bounds {dim: (start, size)} and range of M."""
    if bounds is None:
        return tiles.select("sb_index", F.lit("Ok").alias("result"))
    out = F.when(F.lit(False), F.lit(""))
    for d in DIMS:
        if d in bounds:
            c, (start, size) = F.col(f"dim_{d}"), bounds[d]
            out = out.when(c.isNull(), "Insufficient").when((c < start) | (c >= start + size), "OutOfBounds")
    surplus = [F.col(f"dim_{d}").isNotNull() for d in DIMS if d not in bounds]
    if surplus:
        out = out.when(reduce(lambda a, b: a | b, surplus), "Unexpected")
    if m:
        out = out.when(F.col("m_index").isNull(), "Insufficient").when(~F.col("m_index").between(*m), "OutOfBounds")
    return tiles.select("sb_index", out.otherwise("Ok").alias("result"))


def add_tiles(held: DataFrame, new: DataFrame, bounds: dict[str, tuple[int, int]] | None = None, m: tuple[int, int] | None = None) -> DataFrame:
    """held with new; a tile out of bounds or there already raises when it is read."""
    wrong = bounds_check(new, bounds, m).where("result <> 'Ok'").select("sb_index", "result")
    both = held.select(*new.columns).unionByName(new)
    twice = writer_duplicates(both).select("sb_index", F.lit("Duplicate").alias("result"))
    bad = wrong.unionByName(twice).groupBy("sb_index").agg(F.min("result").alias("_why"))
    out = both.join(bad, "sb_index", "left")
    fine = F.when(F.col("_why").isNotNull(), F.raise_error(F.concat(F.lit("tile "), F.col("sb_index"), F.lit(": "), F.col("_why")))).otherwise(F.lit(True))
    return out.where(fine).select(*new.columns)


def replaced(held: DataFrame, new: DataFrame, key: str = "sb_index") -> DataFrame:
    """held with the rows of the same key replaced; keys that nothing holds are not added. Of several new rows of a key one is taken, the least in all columns."""
    columns = held.columns
    rest = [c for c in columns if c != key]
    one = new.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, *[F.col("_row")[c].alias(c) for c in rest])
    kept = held.join(new.select(key), key, "left_anti").select(*columns)
    return kept.unionByName(one.join(held.select(key), key, "left_semi").select(*columns))


def removed(held: DataFrame, keys: DataFrame, key: str = "sb_index") -> DataFrame:
    return held.join(keys.select(key), key, "left_anti").select(*held.columns)


def unknown_keys(held: DataFrame, keys: DataFrame, key: str = "sb_index") -> DataFrame:
    """The keys that nothing holds: to replace or remove one is an error."""
    return keys.select(key).join(held.select(key), key, "left_anti")


def unique_attachments(attachments: DataFrame) -> DataFrame:
    """The first attachment of each GUID, name and type."""
    same = Window.partitionBy("content_guid", "name", "content_file_type").orderBy("idx")
    return attachments.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")


def all_coordinates(spark: SparkSession, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """(place, dim_...): every coordinate inside the bounds, the first dimension moving fastest; none without bounds. Built from one range, by mixed radix."""
    used = [(d, *bounds[d]) for d in DIMS if d in bounds]
    n = 1
    for _, _, size in used:
        n *= size
    out = spark.range(n if used else 0).withColumnRenamed("id", "place")
    step = 1
    for d, start, size in used:
        out = out.withColumn(f"dim_{d}", F.expr(f"cast({start} + (place div {step}) % {size} as int)"))
        step *= size
    return out


def synthetic_document(spark: SparkSession, bounds: dict[str, tuple[int, int]], rows: int, columns: int, size: tuple[int, int], overlap: float = 0.0, pixel_type: int = 0) -> DataFrame:
    """A directory of mosaics of rows x columns tiles at each coordinate; neighbours share that fraction of their size."""
    w, h = size
    cells = rows * columns
    each = all_coordinates(spark, bounds).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    c, r = F.col("cell") % columns, F.expr(f"cell div {columns}")
    at = lambda k, n: (k * n - F.bround(k * n * overlap)).cast("int")
    dims = [F.col(f"dim_{d}") if d in bounds else F.lit(None).cast("int").alias(f"dim_{d}") for d in DIMS]
    return each.select(
        (F.col("place") * cells + F.col("cell")).alias("sb_index"),
        *dims,
        F.col("cell").cast("int").alias("m_index"),
        at(c, w).alias("x"),
        at(r, h).alias("y"),
        *[F.lit(v).alias(n) for n, v in (("w", w), ("h", h), ("stored_w", w), ("stored_h", h), ("pixel_type", pixel_type), ("compression_raw", 0), ("pyramid_type", 0))],
        ((F.col("place") * cells + F.col("cell")) * (w * h)).alias("file_position"),
    )
