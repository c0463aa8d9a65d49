"""Cutting lineage in a way that survives lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode, where driver and executors are one process, is a
    temporary folder used when the setting is missing.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsa-"))
    return sc.getCheckpointDir()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; Spark or the caller creates it."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """Materialise ``frame`` in the shared folder and forget how it was made."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def dealt(frame: DataFrame, *keys: str) -> DataFrame:
    """``frame`` dealt by keys into ``spark.sql.shuffle.partitions`` parts, which adaptive execution does not join to few large ones.

    Windows and groups of these keys and others follow without another shuffle.
    """
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop, so that any file system works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are no longer used."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
