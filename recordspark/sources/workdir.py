"""The folder that the driver and all executors share, for checkpoints and tables between stages."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from recordspark.plans.model import InvalidConfig


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one that is set for the session, if the master
    is local; on a cluster, where executors couldn't see it, an error."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    now = sc.getCheckpointDir()
    if now is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise InvalidConfig("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="recordspark-"))
        now = sc.getCheckpointDir()
    return now.rsplit("/", 1)[0]  # setCheckpointDir adds a folder of its own


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of the path, and the path, on the driver's JVM."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def removed_at_exit(spark: SparkSession, path: str) -> str:
    """The path, made a folder if it isn't there, which Hadoop deletes when the driver's JVM ends."""
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        fs.mkdirs(at)  # what isn't there can't be marked
    fs.deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def reliable(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder; the session's own folder there goes when the driver's JVM ends."""
    spark = df.sparkSession
    shared_dir(spark)
    removed_at_exit(spark, spark.sparkContext.getCheckpointDir())
    return df.checkpoint()
