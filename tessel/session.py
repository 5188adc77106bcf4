"""Makes the package known to executors."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


#: Rows and bytes of a batch that goes to a Python worker, unless the session says otherwise: rows are whole texts.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b")}


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder's URI in the folder that all executors see, spark.checkpoint.dir; a temporary one where all is one process and that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessel-")
        spark.conf.set("spark.checkpoint.dir", at)
    at = at if "://" in at else f"file://{at.removeprefix('file:')}"
    return f"{at.rstrip('/')}/tessel-{uuid.uuid4().hex}/{tag}"


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application; they may not have it installed."""
    context = spark.sparkContext
    for name, (usual, ours) in BATCH.items():
        if spark.conf.get(name, usual) == usual:
            spark.conf.set(name, ours)
    if context.applicationId not in _shipped:
        home = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{home.name}", "zip", home.parent, home.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over all cores, for work that costs far more than moving its rows: a small file is read by few tasks, whatever its rows cost after that."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
