"""Statistics of a directory that grows: tiles arrive as files, and each batch is folded into a table of partial results.

Boxes, counts and ranges add up, so a batch costs its own size plus the table of scenes. A batch that is delivered
again replaces what it wrote before, since every batch keeps its own version of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessel.functions import geometry as g
from tessel.operators.directory import pyramid_layer
from tessel.schema import NO_SCENE, SUBBLOCKS

_KEYS = ("scene", "factor", "layer")


def partial(tiles: DataFrame) -> DataFrame:
    """Counts and edges for each scene and pyramid layer."""
    factor, layer = pyramid_layer()
    keyed = tiles.select(F.coalesce("dim_s", F.lit(NO_SCENE)).alias("scene"), factor.alias("factor"), layer.alias("layer"), "x", "y", (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    return keyed.groupBy(*_KEYS).agg(F.count("*").alias("n"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def follow(spark: SparkSession, tiles_path: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Follows a folder of Parquet tiles; statistics after batch k stand in out/batch=k."""

    def fold(batch: DataFrame, number: int) -> None:
        now = partial(batch)
        if number > 0:
            now = merged(now.unionByName(spark.read.parquet(f"{out}/batch={number - 1}").select(*now.columns)))
        now.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(SUBBLOCKS).parquet(tiles_path)
    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def layer0_area_by_window(tiles: DataFrame, at: str = "arrived", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Tiles and area of layer 0 for each window of arrival, for batch or stream; rows later than the watermark are dropped by a stream."""
    watched = tiles.withWatermark(at, late) if tiles.isStreaming else tiles
    return watched.where(g.is_layer0()).groupBy(F.window(at, window).alias("window")).agg(F.count("*").alias("n"), F.sum((F.col("w") * F.col("h")).cast("long")).alias("area"))
