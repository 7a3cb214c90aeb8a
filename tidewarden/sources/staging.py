"""Intermediate tables in the cluster's shared folder.

A staged table cuts lineage for good: it outlives lost executors, and its file size gives the
planner a real size to decide a broadcast on.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`.

    Only a local session may go without it: it then gets a folder of its own, which every task of
    that one machine sees.
    """
    folder = spark.conf.get(_CONF, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tidewarden-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def stage(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write `df` once, in directories of `by` if given, and return a reader of the written table."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
