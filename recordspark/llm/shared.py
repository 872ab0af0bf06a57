"""What the operators of this folder share: reading tables, and storage that every executor sees."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordspark.sources.workdir import reliable as checkpointed
from recordspark.sources.workdir import remove, removed_at_exit, shared_dir

__all__ = ["MADE", "checkpointed", "dropped", "importable", "slices", "stored", "table", "unit_interval"]

#: Paths of the tables that stored() has written and nothing has deleted.
MADE: list[str] = []
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver has it, whatever the working folder."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back, which cuts lineage and survives lost executors.
    The table goes when the driver ends, or with dropped()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    MADE.append(removed_at_exit(spark, path))
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, since: int) -> None:
    """Deletes the tables that were stored() since MADE had so many, once nothing reads them any more."""
    while len(MADE) > since:
        remove(spark, MADE.pop())


def unit_interval(*parts) -> F.Column:
    """A number in [0, 1) from the MD5 of the parts' text: the same in every run and in other SQL engines."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a worker holds Python objects of a few rows at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
