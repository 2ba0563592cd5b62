"""Shared folder for cut lineage and intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, a temporary one, on a local master only (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lossloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and go on from there, so that it is computed once."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once as Parquet to the shared folder and go on from the table: compressed, and only the columns that
    are used are read again."""
    path = scratch_table(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deal(df: DataFrame) -> DataFrame:
    """The same rows in even parts, for work that costs much per row: the files read may have few splits or row groups."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


_MADE: dict[str, list[str]] = {}


def scratch_table(spark: SparkSession, name: str) -> str:
    """A new table path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables that this application has made; returns their number.

    Results that were not written elsewhere cannot be read afterwards. Checkpoints are removed by Spark's cleaner where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    paths = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
