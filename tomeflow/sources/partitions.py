"""Partitions of what is read, and where intermediate tables go. Python workers import this module, so it needs nothing but Spark."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used on one machine only, where the session names no shared folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/tomeflow"


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, the folder that the driver and all executors share. A cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or LOCAL_CHECKPOINTS


_made: list[tuple[SparkSession, str]] = []


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder; it is removed when the driver's Python ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_made)
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_made() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # the session may have ended before; then the shared folder's owner cleans up
            return


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the files of a written table that nothing reads any more."""
    drop_path(df.sparkSession, df._written_to)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores. A file of one row group is one task, however many cores wait;
    anything larger already has enough and isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
