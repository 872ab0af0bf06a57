"""Reads of versioned records: what is visible in a change log, scans, point and latest reads.

visible() is what everything else stands on: of each (key, ts) the entry with the largest seq not above the snapshot; of
these the puts that haven't expired; without those whose key a later range tombstone covers. Predicates on key and ts go
below the choice of versions (they are its partition keys, so they reach the Parquet scan); expiry is tested after it,
so that an expired newest version doesn't bring back an older one; range tombstones are never filtered by key.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordspark.operators.ordering import with_ordinals
from recordspark.plans.model import Bound, Op, ScanRange

RECORD = ("key", "ts", "expire_at", "value")
MAX_BROADCAST_RANGES, MAX_BROADCAST_BYTES = 10_000, 16 << 20
#: Buckets of keys to which many ranges are dealt; the square of the second, which a key is compared with twice.
BUCKETS, CHUNK = 4096, 64


def newest(log: DataFrame) -> DataFrame:
    """Of each (key, ts) the entry with the largest seq."""
    w = Window.partitionBy("key", "ts").orderBy(F.col("seq").desc())
    return log.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def without_ranges(rows: DataFrame, ranges: DataFrame, max_broadcast: int = MAX_BROADCAST_RANGES, max_bytes: int = MAX_BROADCAST_BYTES, known: int | None = None) -> DataFrame:
    """rows (key, seq, ...) whose key no later range (low, high, at) covers; a null high has no end. known: how many ranges
    there are at most, if a manifest tells; with 0 no job runs.

    Up to max_broadcast ranges of max_bytes are broadcast. More are dealt to buckets of keys, cut at every nth end of a
    range: one that covers whole buckets counts there by the largest `at` alone, so that a key only meets the ranges
    that begin or end in its bucket, by an equi join.
    """
    if known == 0:
        return rows
    n, size = ranges.agg(F.count("*"), F.sum(F.octet_length("low") + F.coalesce(F.octet_length("high"), F.lit(0)) + 8)).first()
    if n == 0:
        return rows
    covers = (F.col("key") >= F.col("low")) & (F.col("high").isNull() | (F.col("key") < F.col("high"))) & (F.col("at") > F.col("seq"))
    if n <= max_broadcast and size <= max_bytes:
        return rows.join(F.broadcast(ranges), covers, "left_anti")
    ends = with_ordinals(ranges.select(F.explode(F.array("low", "high")).alias("end")).where("end is not null").distinct(), F.col("end"))
    cuts = [r["end"] for r in ends.where(F.col("rn") % max(1, -(-2 * n // BUCKETS)) == 0).orderBy("rn").collect()]  # at most BUCKETS
    placed = ranges.withColumn("first", bucket(F.col("low"), cuts)).withColumn("last", F.when(F.col("high").isNull(), F.lit(len(cuts) + 1)).otherwise(bucket(F.col("high"), cuts)))
    whole = placed.where("last > first + 1").groupBy("first", "last").agg(F.max("at").alias("at"))
    whole = whole.select(F.explode(F.sequence(F.col("first") + 1, F.col("last") - 1)).alias("_bucket"), "at").groupBy("_bucket").agg(F.max("at").alias("_at"))
    ends_in = placed.select("low", "high", "at", F.explode(F.array_distinct(F.array("first", "last"))).alias("_in"))
    if 2 * size <= max_bytes:
        ends_in = F.broadcast(ends_in)
    rows = rows.withColumn("_bucket", bucket(F.col("key"), cuts)).join(F.broadcast(whole), "_bucket", "left")  # a row for each bucket at most
    rows = rows.where(F.coalesce(F.col("_at") <= F.col("seq"), F.lit(True))).join(ends_in, (F.col("_bucket") == F.col("_in")) & covers, "left_anti")
    return rows.drop("_bucket", "_at")


def bucket(key: Column, cuts: list) -> Column:
    """How many of the sorted cuts are not above the key: first among every CHUNK-th, then within that chunk."""
    chunks = [cuts[i : i + CHUNK] for i in range(0, len(cuts), CHUNK)]
    if not chunks:
        return F.lit(0)
    passed = lambda values: F.size(F.filter(values, lambda x: x <= key))
    of = lambda values: F.array(*[F.lit(v) for v in values])
    chunk = passed(of([c[0] for c in chunks]))
    return F.when(chunk == 0, F.lit(0)).otherwise((chunk - 1) * CHUNK + passed(F.element_at(F.array(*map(of, chunks)), chunk)))


def visible(
    log: DataFrame, now_us: int, snapshot_seq: int | None = None, where: Column | None = None, ranges: DataFrame | None = None, max_broadcast: int = MAX_BROADCAST_RANGES, max_bytes: int = MAX_BROADCAST_BYTES, known: int | None = None
) -> DataFrame:
    """The live versions: key, ts, expire_at, value, seq and what else the log holds. where: on key and ts only.
    ranges: the log's range tombstones, if they are kept apart; known: how many there are at most."""
    entries = log.where((F.col("op") == Op.PUT) | (F.col("op") == Op.DELETE))
    if snapshot_seq is not None:
        entries = entries.where(F.col("seq") <= snapshot_seq)
    if where is not None:
        entries = entries.where(where)
    live = newest(entries).where((F.col("op") == Op.PUT) & (F.col("expire_at") > F.lit(now_us)))
    return without_ranges(live, tombstones(log if ranges is None else ranges, snapshot_seq), max_broadcast, max_bytes, known)


def tombstones(log: DataFrame, snapshot_seq: int | None = None) -> DataFrame:
    """The log's range tombstones as (low, high, at)."""
    rows = log.where(F.col("op") == Op.DELETE_RANGE)
    rows = rows if snapshot_seq is None else rows.where(F.col("seq") <= snapshot_seq)
    return rows.select(F.col("key").alias("low"), F.col("range_end").alias("high"), F.col("seq").alias("at"))


def in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("key", "ts")


def scan(log: DataFrame, at: ScanRange, now_us: int, snapshot_seq: int | None = None, **kw) -> DataFrame:
    """A lazy scan; order it with in_order() where the order matters."""
    return visible(log, now_us, snapshot_seq, at.predicate(), **kw)


def get(log: DataFrame, key: Any, ts: int, now_us: int, snapshot_seq: int | None = None, **kw) -> DataFrame:
    """No row or one: the live version of (key, ts)."""
    at = ScanRange(key_low=Bound(key), key_high=Bound(key)).between(ts, ts)
    return scan(log, at, now_us, snapshot_seq, **kw)


def latest(live: DataFrame) -> DataFrame:
    """Of each key the live version with the largest (ts, seq)."""
    w = Window.partitionBy("key").orderBy(F.col("ts").desc(), F.col("seq").desc())
    return live.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def get_latest(log: DataFrame, key: Any, now_us: int, **kw) -> DataFrame:
    return latest(scan(log, ScanRange.key_range(key, key), now_us, **kw))


def time_buckets(rows: DataFrame, width_us: int) -> DataFrame:
    """Least and largest ts, expiry and key, and how many, of each bucket of time (rounded toward zero)."""
    bucket = F.expr(f"ts div {int(width_us)}").alias("bucket")
    return rows.groupBy(bucket).agg(
        F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.max("expire_at").alias("max_expire"), F.count("*").alias("n")
    )
