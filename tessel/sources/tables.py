"""Views over the test tables: no table holds tiles, so directories, pixels, masks and channels are derived by rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tessel.session import ship, spread

_FACTOR = "case event_id % 8 when 5 then 2 when 6 then 4 when 7 then 3 else 1 end"

#: The derivation of the tile directory, in SQL that reads the same for both engines.
SUBBLOCKS_SQL = f"""
select event_id as sb_index,
 cast(user_id % 5 as int) as dim_z,
 cast(case event_type when 'click' then 0 when 'view' then 1 when 'purchase' then 2 else 3 end as int) as dim_c,
 cast(event_id % 7 as int) as dim_t,
 cast(null as int) as dim_r,
 cast(case when event_id % 11 = 0 then null else user_id % 4 end as int) as dim_s,
 cast(null as int) as dim_i, cast(null as int) as dim_h, cast(null as int) as dim_v, cast(null as int) as dim_b,
 cast(case when event_id % 8 <= 4 then event_id % 100 end as int) as m_index,
 cast((event_id*37) % 4096 - 2048 as int) as x,
 cast((event_id*53 + user_id*7) % 4096 - 2048 as int) as y,
 cast(64 * {_FACTOR} as int) as w,
 cast(48 * {_FACTOR} as int) as h,
 64 as stored_w, 48 as stored_h,
 cast(case event_type when 'click' then 0 when 'view' then 1 when 'purchase' then 3 else 4 end as int) as pixel_type,
 cast(case event_id % 4 when 0 then 0 when 1 then 5 when 2 then 6 else 4 end as int) as compression_raw,
 cast(case when event_id % 8 <= 4 then 0 else 2 end as int) as pyramid_type,
 event_id*4096 as file_position
from events
"""

#: The same directory at an eighth of the size, whose tiles of 8 x 6 samples are small enough to paint.
TILES_SQL = f"""
select sb_index, dim_z, dim_c, dim_t, dim_r, dim_s, dim_i, dim_h, dim_v, dim_b, m_index,
 cast(floor(x / 8.0) as int) as x, cast(floor(y / 8.0) as int) as y, cast(w / 8 as int) as w, cast(h / 8 as int) as h, 8 as stored_w, 6 as stored_h,
 pixel_type, compression_raw, pyramid_type, file_position
from ({SUBBLOCKS_SQL}) as s
"""

#: Sample (sx, sy) of a tile of 8 bits, and component k of a tile of any pixel type.
SAMPLE_SQL = "cast((sb_index * 31 + sx * 7 + sy * 13) % 256 as int)"
COMPONENT_SQL = "cast(case when pixel_type in (1, 4) then (sb_index * 131 + sx * 1009 + sy * 2003 + {k} * 4001) % 65536 else (sb_index * 31 + sx * 7 + sy * 13 + {k} * 17) % 256 end as int)"


def _view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for name in tables:
        sql = sql.replace(f"from {name}\n", f"from {{{name}}}\n")
    return spark.sql(sql, **frames)


def subblocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SUBBLOCKS_SQL, "events")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, TILES_SQL, "events")


def samples(batch: pa.RecordBatch) -> pa.Array:
    """The samples of each tile of a batch in its pixel type, row by row, little-endian."""
    index, kind, ws, hs = (np.asarray(batch.column(c).fill_null(0).to_numpy(zero_copy_only=False), np.int64) for c in ("sb_index", "pixel_type", "stored_w", "stored_h"))
    wide, colour = np.isin(kind, (1, 4)), np.isin(kind, (3, 4))
    size = np.where(batch.column("sb_index").is_null().to_numpy(zero_copy_only=False), 0, ws * hs * np.where(wide, 2, 1) * np.where(colour, 3, 1))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    alike = np.stack([wide, colour, ws, hs])
    for key in np.unique(alike[:, size > 0], axis=1).T:
        two, three, w, h = (int(v) for v in key)
        each = np.flatnonzero((alike == key[:, None]).all(axis=0) & (size > 0))
        factors, most = ((131, 1009, 2003, 4001), 65536) if two else ((31, 7, 13, 17), 256)
        sy, sx, k = np.ogrid[0:h, 0:w, 0 : 3 if three else 1]
        place = (sx * factors[1] + sy * factors[2] + k * factors[3]).reshape(1, -1)
        values = ((index[each, None] * factors[0] + place) % most).astype("<u2" if two else np.uint8)
        out[(ends - size)[each, None] + np.arange(size[each[0]])] = values.view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(out)])


def payloads(tiles_: DataFrame, beside: bool = False) -> DataFrame:
    """(sb_index, data): the samples of each tile in its pixel type, row by row, little-endian. beside: all columns of the tiles, and data."""
    ship(tiles_.sparkSession)
    need = ["sb_index", "pixel_type", "stored_w", "stored_h"]
    kept = tiles_.columns if beside else ["sb_index"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), samples(batch)], [*kept, "data"])

    taken = tiles_ if beside else tiles_.select(*need)
    return spread(taken).mapInArrow(rows, StructType([*(tiles_.schema[c] for c in kept), StructField("data", BinaryType())]))


def masks(tiles_: DataFrame) -> DataFrame:
    """(sb_index, mask_w, mask_h, stride, bits): every third tile has a mask, one row shorter than the tile, with a chequered pattern."""
    row = lambda sy: F.when((F.col("sb_index") + sy) % 2 == 0, F.lit("AA")).otherwise(F.lit("55"))
    bits = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), row), ""))
    return tiles_.where("sb_index % 3 = 0").select("sb_index", F.lit(8).alias("mask_w"), F.lit(5).alias("mask_h"), F.lit(1).alias("stride"), bits.alias("bits"))


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments derived from the parts table: few names, few types."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(
        F.col("p_partkey").cast("int").alias("idx"),
        F.md5(F.col("p_partkey").cast("string")).alias("content_guid"),
        F.upper(F.substring("p_brand", 1, 8)).alias("content_file_type"),
        F.col("p_type").alias("name"),
        (F.col("p_partkey") * 512).alias("file_position"),
    )


def null_safe(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
