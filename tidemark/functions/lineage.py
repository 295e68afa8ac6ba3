"""Cutting a plan where several results need the same expensive rows, and the folder for what is written then."""

from __future__ import annotations

import atexit
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files go as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Only a session on one machine that names none gets one of its
    own; on a cluster, executors would not see a folder of the driver's."""
    named, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not sc.getCheckpointDir():
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: it is computed once, and no executor's loss brings it back.

    The shuffle files behind it are then of no more use and go at once, where Spark can do that.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    try:
        spark.conf.set(CLEANUP, "true")
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP, before)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate files, wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove_at_end(spark: SparkSession, folder: str) -> None:
    """Delete a folder when the Python process ends, if its session is still there then."""

    def run() -> None:
        if spark.sparkContext._jsc is not None:
            remove(spark, folder)

    atexit.register(run)
