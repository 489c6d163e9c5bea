"""Materialised stages between expensive steps of a plan."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def stage_root(spark: SparkSession) -> str:
    """This application's folder below the shared one in ``spark.checkpoint.dir``.

    Only a session whose tasks run in one process on one machine (``local[n]``)
    may leave the setting out; on a cluster that is an error, because executors
    would write to folders that others cannot see.
    """
    root = spark.conf.get(KEY, None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {KEY} to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set(KEY, root)
    return f"{root.rstrip('/')}/uptake-{spark.sparkContext.applicationId}"


def new_stage(spark: SparkSession) -> str:
    """A path for one table that nothing else uses."""
    return f"{stage_root(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    Later steps read only the columns they need, nothing upstream runs twice,
    and a lost executor costs no recomputation of earlier stages.
    """
    path = new_stage(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> None:
    """Delete what this application has materialised; its tables can't be read after that."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(stage_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
