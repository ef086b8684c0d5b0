"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A session for tests and the local benchmark. Clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("touchline")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once for each application, through Spark's own file service.

    The archive is built on the driver, which serves it; nothing has to be installed on the executors.
    """
    context = spark.sparkContext
    if getattr(context, "_touchline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # a zip on the path has been shipped by whoever put it there
        handle, name = tempfile.mkstemp(prefix="touchline-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as archive:
            for f in sorted(root.rglob("*.py")):
                archive.write(f, f.relative_to(root.parent))
        context.addPyFile(name)
    context._touchline_shipped = True


def in_small_methods(df: DataFrame, column: str) -> DataFrame:
    """``df`` as it is, its last projection compiled as many small methods: ``column`` passes through a function over an array, which is
    no part of fused code. Projections of dozens of formulas become one method too long for the JVM to compile otherwise."""
    return df.withColumn(column, F.get(F.filter(F.array(column), lambda v: v.isNotNull()), F.lit(0)))


#: Rows and bytes of a batch that goes to Python: long texts count, so rows alone would not bound a worker's memory.
BATCH_LIMITS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def prepare(spark: SparkSession) -> None:
    """Ship the package and bound the batches of Python functions over texts, where the session leaves them open."""
    ship_package(spark)
    for key, value in BATCH_LIMITS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, executors may go.

    Used by iterative jobs only. A partitioned stage lets later steps read just their slice.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
