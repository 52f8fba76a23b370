"""Cut lineage by writing a table to the cluster's shared checkpoint folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_root() -> str:
    """One folder for this process; the setting itself cannot be changed in a running session."""
    return tempfile.mkdtemp(prefix="attesta-")


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; local runs get a fresh folder.

    A machine-local folder would be lost with its executor, so an unset
    setting is an error anywhere but in local mode.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    return _local_root()


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once (with the writer's ``options``) and read it back: columnar, prunable, survives executor loss."""
    path = stage_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a scan that comes in fewer pieces than there are cores one piece per core.

    Small single-row-group files only; a scan with enough splits is returned
    as it is, so nothing is shuffled on large inputs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
