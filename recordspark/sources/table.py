"""A table of versioned records: an append-only change log in Parquet with a commit log, and its maintenance.

Each batch is written by Spark as one folder, then published by one manifest version: readers see all of it or none, and
a batch that a crash cut off is never listed. seq is given by an explicit ordinal within the batch on top of the highest
seq, which the manifest keeps. Range tombstones are counted for each part, so that reads open only parts that have some,
and no job runs to look for them where there are none.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordspark.functions.paths import with_ttl
from recordspark.operators import records
from recordspark.plans.model import NEVER, Config, InvalidArgument, NotFound, Op, ScanRange, TransactionConflict, changelog_schema
from recordspark.sources.manifest import Files, Manifest, Part, StoreManifest, Version


class Latency:
    """How long operations took: counts by power-of-two steps of a quarter, in microseconds, so that percentiles need no samples."""

    STEPS = 4  # to a doubling

    def __init__(self):
        self.counts: dict[int, int] = {}
        self.n, self.total_us = 0, 0

    def add(self, us: float) -> None:
        at = max(0, math.ceil(self.STEPS * math.log2(max(1.0, us))))
        self.counts[at] = self.counts.get(at, 0) + 1
        self.n, self.total_us = self.n + 1, self.total_us + us

    def percentile(self, q: float) -> float:
        """An upper bound, less than a fifth above the value; 0 before the first operation."""
        left = max(1, math.ceil(q * self.n))
        for at in sorted(self.counts):
            if (left := left - self.counts[at]) <= 0:
                return 2.0 ** (at / self.STEPS)
        return 0.0


@dataclass
class Stats:
    records_written: int = 0
    records_read: int = 0
    records_deleted: int = 0
    bytes_written: int = 0
    bytes_compacted_in: int = 0
    bytes_compacted_out: int = 0
    batches: int = 0
    queries: int = 0
    point_reads: int = 0
    compactions: int = 0
    gc_runs: int = 0
    records_purged: int = 0
    conflicts: int = 0
    last_write_us: int = 0
    last_compaction_us: int = 0
    last_gc_us: int = 0
    #: Of what the newest version holds, when it was last looked at.
    parts: int = 0
    live_bytes: int = 0
    live_entries: int = 0
    tombstones: int = 0
    latency: dict[str, Latency] = field(default_factory=lambda: {x: Latency() for x in ("write", "read", "compaction", "gc")})

    GAUGES = ("parts", "live_bytes", "live_entries", "tombstones")

    @contextmanager
    def timed(self, what: str) -> Iterator[None]:
        began = time.perf_counter()
        yield
        self.latency[what].add((time.perf_counter() - began) * 1e6)

    def looked_at(self, version: Version) -> None:
        p = version.parts
        self.parts, self.live_bytes, self.live_entries, self.tombstones = len(p), sum(x.bytes for x in p), sum(x.rows for x in p), sum(x.tombstones for x in p)

    def ratios(self) -> dict[str, float]:
        """Bytes written in all for each byte that came in; tombstones' share of entries; bytes that compaction leaves."""
        share = lambda a, b: a / b if b else 0.0
        return {
            "write_amplification": share(self.bytes_written + self.bytes_compacted_out, self.bytes_written), "tombstone_ratio": share(self.tombstones, self.live_entries),
            "compaction_ratio": share(self.bytes_compacted_out, self.bytes_compacted_in),
        }

    def metrics_text(self, prefix: str = "recordspark") -> str:
        """In Prometheus's text form."""
        plain = {k: v for k, v in vars(self).items() if k != "latency"}
        lines = [f"# TYPE {prefix}_{k} {'gauge' if k.startswith('last_') or k in self.GAUGES else 'counter'}\n{prefix}_{k} {v}\n" for k, v in plain.items()]
        lines += [f"# TYPE {prefix}_{k} gauge\n{prefix}_{k} {v:.6g}\n" for k, v in self.ratios().items()]
        for what, x in self.latency.items():
            name = f"{prefix}_{what}_latency_us"
            lines.append(f"# TYPE {name} summary\n" + "".join(f'{name}{{quantile="{q}"}} {x.percentile(q):.6g}\n' for q in (0.5, 0.9, 0.99)) + f"{name}_sum {x.total_us:.6g}\n{name}_count {x.n}\n")
        return "".join(lines)


class RecordTable:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, key_type: T.DataType | None = None, clock=lambda: time.time_ns() // 1000, manifest: StoreManifest | None = None):
        self.spark, self.path, self.clock = spark, path.rstrip("/"), clock
        self.config = (config or Config()).validate()
        self.schema = changelog_schema(key_type or T.StringType())
        self.files = Files(spark, path)
        self.manifest = manifest or Manifest(self.files)
        self.stats = Stats()

    # Reading

    @property
    def bounds(self) -> tuple[int, int]:
        return self.config.max_broadcast_ranges, self.config.max_broadcast_bytes

    @property
    def last_seq(self) -> int:
        return self.manifest.current().last_seq

    def log(self, version: Version | None = None, ranges_only: bool = False) -> DataFrame:
        version = version or self.manifest.current()
        return self.read_parts([p for p in version.parts if p.ranges or not ranges_only])

    def read_parts(self, parts: list[Part]) -> DataFrame:
        schema = self.schema
        if self.config.ts_bucket_us:
            schema = T.StructType([*schema.fields, T.StructField("ts_bucket", T.LongType()), T.StructField("part", T.StringType())])
        if not parts:
            return self.spark.createDataFrame([], schema).drop("part")
        read = self.spark.read.schema(schema)
        if self.config.ts_bucket_us:  # the buckets, and the parts' names, are in the paths
            read = read.option("basePath", f"{self.path}/data")
        return read.parquet(*[f"{self.path}/{p.path}" for p in parts]).drop("part")

    def scan(self, at: ScanRange | None = None, snapshot_seq: int | None = None, now_us: int | None = None, version: Version | None = None) -> DataFrame:
        """The live versions, lazily: key, ts, expire_at, value, seq."""
        version = version or self.manifest.current()
        where = (at or ScanRange()).predicate(bucket="ts_bucket" if self.config.ts_bucket_us else None, width_us=self.config.ts_bucket_us)
        now = self.clock() if now_us is None else now_us
        tail = self.after_merged(version, snapshot_seq)
        if tail is None:
            live = records.visible(self.log(version), now, snapshot_seq, where, self.log(version, ranges_only=True), *self.bounds, known=sum(p.ranges for p in version.parts))
            return live.select(*records.RECORD, "seq")
        # The merged part holds one version of each (key, ts): it is filtered as it is read, without a shuffle of its rows.
        base = self.read_parts([p for p in version.parts if p.merged]).where(where).where(F.col("expire_at") > F.lit(now))
        if not tail:
            return base.select(*records.RECORD, "seq")
        newer = self.read_parts(tail).where(where)
        newer = newer if snapshot_seq is None else newer.where(F.col("seq") <= snapshot_seq)
        changed = newer.where(F.col("op") != Op.DELETE_RANGE).select("key", "ts").distinct()
        if sum(p.rows for p in tail) <= self.config.max_broadcast_rows and sum(p.bytes for p in tail) <= self.config.max_broadcast_bytes:
            changed = F.broadcast(changed)
        ranges = self.read_parts([p for p in tail if p.ranges])
        known = sum(p.ranges for p in tail)
        base = base.join(changed, ["key", "ts"], "left_anti")
        base = records.without_ranges(base, records.tombstones(ranges, snapshot_seq), *self.bounds, known=known)
        live = records.visible(self.read_parts(tail), now, snapshot_seq, where, ranges, *self.bounds, known=known)
        return base.select(*records.RECORD, "seq").unionByName(live.select(*records.RECORD, "seq"))

    @staticmethod
    def after_merged(version: Version, snapshot_seq: int | None) -> list[Part] | None:
        """The parts that came after the one merged part; None if there is no such part that is older than all others."""
        merged = [p for p in version.parts if p.merged]
        if len(merged) != 1 or snapshot_seq is not None and snapshot_seq < merged[0].max_seq:
            return None
        rest = [p for p in version.parts if not p.merged]
        return rest if all(p.min_seq > merged[0].max_seq for p in rest) else None

    def query(self, at: ScanRange, now_us: int | None = None) -> list[Row]:
        with self.stats.timed("read"):
            out = records.in_order(self.scan(at, now_us=now_us)).collect()
        self.stats.queries += 1
        self.stats.records_read += len(out)
        return out

    def get(self, key: Any, ts: int, snapshot_seq: int | None = None, now_us: int | None = None) -> Row | None:
        return self._one(self.scan(ScanRange.key_time_range(key, key, ts, ts), snapshot_seq, now_us))

    def get_latest(self, key: Any, now_us: int | None = None) -> Row | None:
        return self._one(records.latest(self.scan(ScanRange.key_range(key, key), now_us=now_us)))

    def _one(self, rows: DataFrame) -> Row | None:
        with self.stats.timed("read"):
            row = rows.first()
        self.stats.point_reads += 1
        self.stats.records_read += row is not None
        return row

    def latest(self, at: ScanRange | None = None, now_us: int | None = None) -> DataFrame:
        return records.latest(self.scan(at, now_us=now_us))

    # Writing

    def append(self, entries: DataFrame, base: Version | None = None, state: dict | None = None) -> Version:
        """entries: key, ts, expire_at, value, op, range_end and ordinal (1, 2, ... in the order of the batch)."""
        base = base or self.manifest.current()
        with self.stats.timed("write"):
            new = self.staged(entries, base, state)
            try:
                new = self.manifest.publish(base, new)
            except TransactionConflict:
                self.stats.conflicts += 1
                raise
        self.published(base, new)
        return new

    def staged(self, entries: DataFrame, base: Version, state: dict | None = None) -> Version:
        """Writes the entries' part; the version that would have it on top of base, not yet published."""
        rows = entries.withColumn("seq", (F.col("ordinal") + F.lit(base.last_seq)).cast("long"))
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        part = self._write(rows)
        return replace(base, number=base.number + 1, last_seq=max(base.last_seq, part.max_seq), parts=(*base.parts, part) if part.rows else base.parts, state=base.state if state is None else state)

    def published(self, base: Version, new: Version) -> None:
        """What follows a commit: counters, and a shorter log now and then."""
        own = [p for p in new.parts if p not in base.parts]
        self.stats.batches += 1
        self.stats.records_written += sum(p.rows for p in own)
        self.stats.records_deleted += sum(p.tombstones for p in own)
        self.stats.bytes_written += sum(p.bytes for p in own)
        self.stats.last_write_us = self.clock()
        self.stats.looked_at(new)
        if new.number % self.config.manifest_snapshot_every == 0:
            self.manifest.snapshot(keep=2)

    def _write(self, rows: DataFrame, merged: bool = False) -> Part:
        name = f"data/part={uuid.uuid4().hex}"
        writer = rows
        if self.config.ts_bucket_us:
            writer = rows.withColumn("ts_bucket", F.floor(F.col("ts") / F.lit(self.config.ts_bucket_us)).cast("long"))
        out = writer.write.option("compression", self.config.compression).option("parquet.bloom.filter.enabled#key", "true")
        if self.config.compression == "zstd" and self.config.compression_level:
            out = out.option("parquet.compression.codec.zstd.level", str(self.config.compression_level))
        (out.partitionBy("ts_bucket") if self.config.ts_bucket_us else out).parquet(f"{self.path}/{name}")
        written = self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}").select(*self.schema.names)
        s = written.agg(
            F.count("*").alias("rows"), F.coalesce(F.max("expire_at"), F.lit(0)).alias("max_expire"), F.coalesce(F.min("seq"), F.lit(0)).alias("min_seq"), F.coalesce(F.max("seq"), F.lit(0)).alias("max_seq"),
            F.count_if(F.col("op") != Op.PUT).alias("tombstones"), F.count_if(F.col("op") == Op.DELETE_RANGE).alias("ranges"),
        ).first()
        return Part(name, s["rows"], self.files.size(name), s["max_expire"], s["min_seq"], s["max_seq"], s["tombstones"], s["ranges"], merged)

    def entries(self, rows: Iterable[tuple]) -> DataFrame:
        """From (op, key, ts, expire_at, value, range_end) in order; a small batch that the driver already holds."""
        key = self.schema["key"].dataType
        schema = T.StructType([*self.schema.fields[:4], T.StructField("op", T.ByteType()), T.StructField("range_end", key), T.StructField("ordinal", T.LongType())])
        return self.spark.createDataFrame([(k, ts, exp, None if v is None else bytearray(v), int(op), end, i + 1) for i, (op, k, ts, exp, v, end) in enumerate(rows)], schema)

    def write_batch(self, batch: DataFrame | Iterable[tuple], ttl_s: int | None = None) -> Version:
        """batch: (key, ts, value[, expire_at]) in order, or a DataFrame of key, ts, value, ordinal and perhaps expire_at.
        A ttl counts from the record's ts and replaces its expire_at."""
        ttl = self.config.default_ttl_s if ttl_s is None else ttl_s
        if ttl is not None and ttl <= 0:
            raise InvalidArgument("a ttl must be above 0")
        if isinstance(batch, DataFrame):
            if "ordinal" not in batch.columns:
                raise InvalidArgument("a batch needs the column ordinal: the order in which later rows win")
            rows = batch.withColumn("op", F.lit(int(Op.PUT))).withColumn("range_end", F.lit(None))
            rows = rows if "expire_at" in batch.columns else rows.withColumn("expire_at", F.lit(NEVER))
        else:
            rows = self.entries((Op.PUT, r[0], r[1], r[3] if len(r) > 3 else NEVER, r[2], None) for r in batch)
        return self.append(rows.withColumn("expire_at", with_ttl(F.col("ts"), ttl, F.col("expire_at"))))

    def delete_batch(self, keys: Iterable[tuple[Any, int]]) -> Version:
        return self.append(self.entries((Op.DELETE, k, ts, NEVER, None, None) for k, ts in keys))

    def delete_range(self, start: Any, end: Any) -> Version:
        """Hides the keys in [start, end), or all from start on if end is None, at all ts; later puts show again."""
        return self.append(self.entries([(Op.DELETE_RANGE, start, 0, NEVER, None, end)]))

    def patch_record(self, key: Any, ts: int, value: bytes | None = None, ttl_s: int | None = None) -> Version:
        base = self.manifest.current()
        now = self.scan(ScanRange.key_time_range(key, key, ts, ts), version=base).first()
        if now is None:
            raise NotFound(f"record {key!r} at {ts} not found")
        expire = now["expire_at"] if ttl_s is None else min(NEVER, ts + ttl_s * 1_000_000)
        return self.append(self.entries([(Op.PUT, key, ts, expire, now["value"] if value is None else value, None)]), base)

    def flush(self) -> None:
        """Every commit is already in files."""

    # Maintenance

    def picked(self, version: Version) -> list[Part]:
        """The smallest part and all up to `compaction_ratio` times its size, if parts are many and these are two or more."""
        if len(version.parts) < self.config.compaction_threshold:
            return []
        parts = sorted(version.parts, key=lambda p: p.bytes)
        near = [p for p in parts if p.bytes <= self.config.compaction_ratio * max(1, parts[0].bytes)]
        return near if len(near) >= 2 else []

    def compact(self) -> bool:
        """Merges the picked parts. Tombstones go only when every older part is in the merge; seqs stay."""
        base = self.manifest.current()
        chosen = self.picked(base)
        if not chosen:
            return False
        with self.stats.timed("compaction"):
            self._compact(base, chosen)
        return True

    def _compact(self, base: Version, chosen: list[Part]) -> None:
        rows = self.read_parts(chosen).select(*self.schema.names)
        newest_seq = max(p.max_seq for p in chosen)
        whole = all(p in chosen for p in base.parts if p.min_seq <= newest_seq)
        points = records.newest(rows.where(F.col("op") != Op.DELETE_RANGE))
        covered = records.without_ranges(points, records.tombstones(rows), *self.bounds, known=sum(p.ranges for p in chosen))
        merged = covered.where(F.col("op") == Op.PUT) if whole else covered.unionByName(rows.where(F.col("op") == Op.DELETE_RANGE))
        # Files of 128 MB; of less, down to 4 MB, where a read would leave cores idle.
        size = sum(p.bytes for p in chosen)
        n = max(1, size // (128 << 20), min(self.spark.sparkContext.defaultParallelism, size // (4 << 20)))
        part = self._write(merged.repartitionByRange(n, "key").sortWithinPartitions("key", "ts"), merged=whole)
        # Readers of an older version still need the old folders; vacuum() removes them later.
        kept = tuple(p for p in base.parts if p not in chosen)
        self.stats.looked_at(self.manifest.commit(base, parts=(*kept, part) if part.rows else kept))
        self.stats.compactions += 1
        self.stats.bytes_compacted_in += sum(p.bytes for p in chosen)
        self.stats.bytes_compacted_out += part.bytes
        self.stats.last_compaction_us = self.clock()

    def gc(self, now_us: int | None = None) -> int:
        """Drops whole parts whose every record has expired; parts with tombstones stay. Returns the records dropped."""
        now, base = self.clock() if now_us is None else now_us, self.manifest.current()
        with self.stats.timed("gc"):
            gone = [p for p in base.parts if p.max_expire < now and not p.tombstones and self._newest_everywhere(p, base)]
            if gone:
                self.stats.looked_at(self.manifest.commit(base, parts=tuple(p for p in base.parts if p not in gone)))
        purged = sum(p.rows for p in gone)
        self.stats.gc_runs += 1
        self.stats.records_purged += purged
        self.stats.last_gc_us = self.clock()
        return purged

    def _newest_everywhere(self, part: Part, version: Version) -> bool:
        """Whether no older part holds a version that an expired one of this part hides."""
        older = [p for p in version.parts if p.min_seq < part.max_seq and p != part]
        if not older:
            return True
        return self.read_parts([part]).select("key", "ts").join(self.read_parts(older).where(F.col("op") == Op.PUT).select("key", "ts"), ["key", "ts"], "left_semi").isEmpty()

    def vacuum(self, keep_versions: int = 1) -> int:
        """Removes old versions and the data folders that no kept version names; returns how many folders."""
        self.manifest.snapshot(keep_versions)
        named = {p.path for v in self.manifest.versions() for p in v.parts}
        gone = [f"data/{x}" for x in self.files.list("data") if f"data/{x}" not in named]
        for x in gone:
            self.files.delete(x)
        return len(gone)

    def maintain(self, now_us: int | None = None) -> dict[str, int]:
        """One round of what a background thread would do: call it from a scheduler."""
        return {"compacted": int(self.compact()), "purged": self.gc(now_us), "removed": self.vacuum()}

    def part_stats(self) -> DataFrame:
        """A row for each part of the newest version."""
        parts = [tuple(asdict(p).values()) for p in self.manifest.current().parts]
        return self.spark.createDataFrame(parts, "path string, rows long, bytes long, max_expire long, min_seq long, max_seq long, tombstones long, ranges long, merged boolean")
