"""What the operators share: the shared folder, written intermediate tables, small helpers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words.
SPACE = r"[\x20\x09-\x0D]+"
#: A null id inside tables; it sorts before every other id. A doc_id of this very value, the least there is, comes back as null.
NO_ID = -(2**63)
#: Bytes of text that one vectorised step works on; its arrays take some forty times as much.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only where all is one process, as in tests, is one made if it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not (spark.sparkContext.master or "").startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessel-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tessel-{uuid.uuid4().hex}/{tag}"


#: Makes Spark delete the shuffle files of a query when it ends; else they stay until the driver's garbage is collected.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage, survives lost executors. Its shuffle files go at once."""
    path, conf = new_path(df.sparkSession, tag), df.sparkSession.conf
    before = conf.get(TIDY, None)
    conf.set(TIDY, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)
    finally:
        conf.set(TIDY, before) if before else conf.unset(TIDY)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.tessel_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table that written() made, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.tessel_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trimmed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; when they end, the worker gives freed memory back, since it waits for its next task with what it has."""
    yield from rows
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def table_bytes(df: DataFrame) -> int:
    """The size of the files of a table that written() made."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.tessel_path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each with underscores appended until no column of df has it (letter case ignored)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most limit bytes of the column, or one row."""
    for batch in batches:
        size = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(size):
            if total + n > limit and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if len(size) > start:
            yield batch.slice(start)


def words_column(text) -> F.Column:
    """The words of a text as an array, in the JVM; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value, body) -> F.Column:
    """body(value) with value computed once for each row, though body uses it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not in gone (one column of ids, null counting as an id)."""
    (name,) = fresh(docs, "_gone")
    gone = gone.toDF(name).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col(name)), "left_anti")
