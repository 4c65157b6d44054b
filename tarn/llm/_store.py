"""Cutting lineage in the shared folder, reading tables and shipping this package to Python workers."""

from __future__ import annotations

import atexit
import os
import re
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROOT = Path(__file__).resolve().parents[2]
#: Bytes of a row group in intermediate tables: what a writer holds and a reader takes at once, rows being whole texts or postings of many.
ROW_GROUP = 16 << 20
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder and any other one of the cluster's default file system.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            where = "file://" + tempfile.mkdtemp(prefix="tarn-")
        else:
            jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            where = f"{jvm.org.apache.hadoop.fs.FileSystem.get(conf).getHomeDirectory().toString()}/.tarn"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read again: what comes later survives lost executors without recomputing df.

    Shuffle files of the job that wrote it are dropped once it has ended, so that disk holds one phase at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarn-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    _written.append((spark, path))
    found = spark.read.schema(df.schema).parquet(path)
    found._tarn_path = path
    return found


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """df, written with a number for each row, and the name of that column: rows are told apart whatever they hold."""
    name = "row"
    while name in df.columns:
        name += "_"
    return written(df.withColumn(name, F.monotonically_increasing_id())), name


def forget(*tables: DataFrame) -> None:
    """Deletes what written() wrote for tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_tarn_path", None)
        if path:
            _delete(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001, PERF203  the session may be gone
            return


#: Rows and bytes of an Arrow batch, where the session leaves Spark's defaults: rows are whole texts here.
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20


def ship(spark: SparkSession) -> None:
    """Gives Python workers this package, unless they find it as the driver does, and batches of bounded size."""
    for key, usual, own in (("maxRecordsPerBatch", ("10000",), ARROW_ROWS), ("maxBytesPerBatch", (str(2**31 - 1), str(2**63 - 1), "-1"), ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, usual[0]).removesuffix("b") in usual:
            spark.conf.set(key, str(own))
    found = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(_ROOT) in found or os.path.realpath(os.getcwd()) == str(_ROOT) or getattr(spark.sparkContext, "_tarn_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="tarn-"), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in package.rglob("*.py"):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(target)
    spark.sparkContext._tarn_shipped = True
    sys.modules.setdefault(package.name, sys.modules[package.name])
