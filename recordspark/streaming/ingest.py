"""Streams: micro-batches into a record table, and windows over record time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordspark.sources.table import RecordTable


def ingest(stream: DataFrame, table: RecordTable, checkpoint: str, order_by: list[str], available_now: bool = True) -> StreamingQuery:
    """stream: key, ts, value. Each micro-batch is one commit; a batch that comes again after a crash is skipped, as the
    manifest notes the number of the last. order_by: what tells later rows from earlier ones within a key and ts."""

    def write(batch: DataFrame, number: int) -> None:
        base = table.manifest.current()
        if base.state.get("batch", -1) >= number:
            return
        # Later rows must win within a (key, ts) alone, so the ordinal counts there, not over the whole batch.
        w = Window.partitionBy("key", "ts").orderBy(*order_by)
        rows = batch.withColumn("ordinal", F.row_number().over(w)).withColumn("expire_at", F.lit((1 << 63) - 1)).withColumn("op", F.lit(0)).withColumn("range_end", F.lit(None))
        table.append(rows, base, state=base.state | {"batch": number})

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def windows(stream: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and extremes of ts by window of record time; rows later than `late` are dropped. stream: key, ts, ..."""
    at = F.timestamp_micros("ts")
    timed = stream.withColumn("at", at).withWatermark("at", late)
    window = F.window("at", width, slide) if slide else F.window("at", width)
    return timed.groupBy(window).agg(F.count("*").alias("n"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))
