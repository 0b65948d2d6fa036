"""Work tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset and all runs in one process, as in tests, a
    temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        known = context._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
        if not found and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="tessera-")
            context.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def work_table(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again; lineage ends there."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
