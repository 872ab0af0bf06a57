"""Ordinals in a total order without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordspark.sources.workdir import reliable


def with_ordinals(df: DataFrame, *order: Column, name: str = "rn") -> DataFrame:
    """df with the place (from 1) of each row in the order.

    A range-partitioned sort, whose partitions' counts give each partition's start; a checkpoint between keeps both
    passes alike. The counts are a row for each partition.
    """
    row = F.monotonically_increasing_id()  # the partition's number in the upper bits, the row's place below
    placed = reliable(df.orderBy(*order).withColumn("_at", row))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    up_to = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(up_to), F.lit(0))).drop("_n")
    out = placed.withColumn("_part", part).join(starts, "_part").withColumn(name, (F.col("_start") + place + 1).cast("long"))
    return out.drop("_part", "_start", "_at")
