"""Intermediate tables below ``spark.checkpoint.dir``, which the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a folder of our own.

    A local master has one machine, so its temp folder is shared; elsewhere the warehouse is.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        if local:
            found = tempfile.mkdtemp(prefix="voucherflow-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
        else:
            found = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_own: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the application's own folder, which goes when the application ends."""
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if folder not in _own:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)
        _own.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and fixes what was computed.

    The shuffle files of the write go with its end: nothing reads them again, and those of many writes in turn would add up.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    kept = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove what ``written`` wrote, once nothing reads it any more."""
    jvm = table.sparkSession._jvm
    for folder in {x.rsplit("/", 1)[0] for x in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
