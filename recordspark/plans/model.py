"""What users state: records, scans, key ranges, stores, configuration; and the errors."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace
from enum import IntEnum
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEVER = (1 << 63) - 1  # expire_at of a record that doesn't expire


class EngineError(Exception):
    """Base of all errors."""


class NotFound(EngineError): ...


class AlreadyExists(EngineError): ...


class UniqueViolation(EngineError): ...


class TransactionConflict(EngineError): ...


class ReadOnlyTransaction(EngineError): ...


class InvalidArgument(EngineError): ...


class InvalidConfig(EngineError): ...


class SchemaMismatch(EngineError): ...


class Corrupt(EngineError): ...


class Closed(EngineError): ...


class Op(IntEnum):
    PUT = 0
    DELETE = 1  # one (key, ts)
    DELETE_RANGE = 2  # keys in [key, range_end), at all ts; without a range_end all from key on


def record_schema(key: T.DataType = T.StringType()) -> T.StructType:
    return T.StructType([T.StructField("key", key, False), T.StructField("ts", T.LongType(), False), T.StructField("expire_at", T.LongType(), False), T.StructField("value", T.BinaryType())])


def changelog_schema(key: T.DataType = T.StringType()) -> T.StructType:
    return T.StructType([*record_schema(key).fields, T.StructField("seq", T.LongType(), False), T.StructField("op", T.ByteType(), False), T.StructField("range_end", key)])


@dataclass(frozen=True)
class Bound:
    """One end of a range: its value, or none; with or without the value itself."""

    value: Any = None
    included: bool = True

    @property
    def open_ended(self) -> bool:
        return self.value is None

    def above(self, c: Column) -> Column | None:
        return None if self.open_ended else c >= F.lit(self.value) if self.included else c > F.lit(self.value)

    def below(self, c: Column) -> Column | None:
        return None if self.open_ended else c <= F.lit(self.value) if self.included else c < F.lit(self.value)


def conjunction(terms: list[Column | None]) -> Column:
    out = F.lit(True)
    for i, term in enumerate(x for x in terms if x is not None):
        out = term if i == 0 else out & term
    return out


UNBOUNDED = Bound()


@dataclass(frozen=True)
class ScanRange:
    """A key prefix or key bounds, and time bounds. Every bound is honoured as it is given."""

    prefix: Any = None
    key_low: Bound = UNBOUNDED
    key_high: Bound = UNBOUNDED
    ts_low: Bound = UNBOUNDED
    ts_high: Bound = UNBOUNDED

    @classmethod
    def all(cls) -> ScanRange:
        return cls()

    @classmethod
    def of_prefix(cls, prefix: Any) -> ScanRange:
        return cls(prefix=prefix)

    @classmethod
    def key_range(cls, start: Any, end: Any) -> ScanRange:
        """Closed at both ends."""
        return cls(key_low=Bound(start), key_high=Bound(end))

    def between(self, start: int, end: int) -> ScanRange:
        """With a closed range of ts."""
        return replace(self, ts_low=Bound(start), ts_high=Bound(end))

    @classmethod
    def time_range(cls, start: int, end: int) -> ScanRange:
        return cls().between(start, end)

    @classmethod
    def prefix_time_range(cls, prefix: Any, start: int, end: int) -> ScanRange:
        return cls(prefix=prefix).between(start, end)

    @classmethod
    def key_time_range(cls, low: Any, high: Any, start: int, end: int) -> ScanRange:
        return cls.key_range(low, high).between(start, end)

    def predicate(self, key: str = "key", ts: str = "ts", bucket: str | None = None, width_us: int | None = None) -> Column:
        """On key and ts alone, so that it sinks below the choice of versions into the scan. bucket: a partition column of
        floor(ts / width_us), for which bounds are derived."""
        k, t = F.col(key), F.col(ts)
        prefix = None if self.prefix is None or len(self.prefix) == 0 else k.startswith(F.lit(self.prefix))
        terms = [prefix, self.key_low.above(k), self.key_high.below(k), self.ts_low.above(t), self.ts_high.below(t)]
        if bucket and width_us:
            if not self.ts_low.open_ended:
                terms.append(F.col(bucket) >= F.lit(self.ts_low.value // width_us))
            if not self.ts_high.open_ended:
                terms.append(F.col(bucket) <= F.lit(self.ts_high.value // width_us))
        return conjunction(terms)


Query = ScanRange  # the closed forms above are the query kinds


@dataclass(frozen=True)
class KeyRange:
    """Lower and upper bound, each open or closed, in the order of the type it is used on."""

    lower: Any = None
    upper: Any = None
    lower_open: bool = False
    upper_open: bool = False

    @classmethod
    def only(cls, value: Any) -> KeyRange:
        return cls(value, value)

    @classmethod
    def bound(cls, lower: Any, upper: Any, lower_open: bool = False, upper_open: bool = False) -> KeyRange:
        return cls(lower, upper, lower_open, upper_open)

    @classmethod
    def lower_bound(cls, lower: Any, is_open: bool = False) -> KeyRange:
        return cls(lower=lower, lower_open=is_open)

    @classmethod
    def upper_bound(cls, upper: Any, is_open: bool = False) -> KeyRange:
        return cls(upper=upper, upper_open=is_open)

    @property
    def is_unbounded(self) -> bool:
        return self.lower is None and self.upper is None

    def predicate(self, c: Column, literal=F.lit) -> Column:
        low = None if self.lower is None else c > literal(self.lower) if self.lower_open else c >= literal(self.lower)
        high = None if self.upper is None else c < literal(self.upper) if self.upper_open else c <= literal(self.upper)
        return conjunction([low, high])

    def includes(self, value: Any) -> bool:
        """The same test on a Python value, in the order across types."""
        from recordspark.functions.paths import order_key

        v = order_key(value)
        low = self.lower is None or (v > order_key(self.lower) if self.lower_open else v >= order_key(self.lower))
        return low and (self.upper is None or (v < order_key(self.upper) if self.upper_open else v <= order_key(self.upper)))


NAME = re.compile(r"[A-Za-z0-9_-]{1,255}")


def checked_name(name: str) -> str:
    if not NAME.fullmatch(name):
        raise InvalidArgument(f"invalid name {name!r}: 1 to 255 of A-Z, a-z, 0-9, _ and -")
    return name


@dataclass(frozen=True)
class IndexDef:
    name: str
    key_paths: tuple[str, ...]
    unique: bool = False
    multi_entry: bool = False

    def __post_init__(self):
        checked_name(self.name)
        if not self.key_paths or not all(self.key_paths):
            raise InvalidArgument(f"index {self.name} needs key paths")

    @classmethod
    def from_json(cls, x: dict) -> IndexDef:
        paths = x.get("key_paths") or [x["key_path"]]  # an older form names one path
        return cls(x["name"], tuple(paths), bool(x.get("unique")), bool(x.get("multi_entry")))


@dataclass(frozen=True)
class StoreDef:
    name: str
    key_path: str
    auto_increment: bool = False
    indexes: tuple[IndexDef, ...] = ()

    def __post_init__(self):
        checked_name(self.name)
        if not self.key_path:
            raise InvalidArgument(f"store {self.name} needs a key path")
        if self.auto_increment and "." in self.key_path:
            raise InvalidArgument("an auto-increment store's key path can't be dotted")
        if len({i.name for i in self.indexes}) < len(self.indexes):
            raise AlreadyExists(f"an index name of {self.name} already exists")

    def with_index(self, name: str, key_paths: str | list[str], unique: bool = False, multi_entry: bool = False) -> StoreDef:
        paths = (key_paths,) if isinstance(key_paths, str) else tuple(key_paths)
        if any(i.name == name for i in self.indexes):
            raise AlreadyExists(f"index {name} already exists")
        return replace(self, indexes=(*self.indexes, IndexDef(name, paths, unique, multi_entry)))

    def without_index(self, name: str) -> StoreDef:
        self.index(name)
        return replace(self, indexes=tuple(i for i in self.indexes if i.name != name))

    def with_auto_increment(self) -> StoreDef:
        return replace(self, auto_increment=True)

    def index(self, name: str) -> IndexDef:
        for i in self.indexes:
            if i.name == name:
                return i
        raise NotFound(f"index {name} not found in {self.name}")

    def to_json(self) -> dict:
        return {"name": self.name, "key_path": self.key_path, "auto_increment": self.auto_increment, "indexes": [{"name": i.name, "key_paths": list(i.key_paths), "unique": i.unique, "multi_entry": i.multi_entry} for i in self.indexes]}

    @classmethod
    def from_json(cls, x: dict) -> StoreDef:
        return cls(x["name"], x["key_path"], bool(x.get("auto_increment")), tuple(map(IndexDef.from_json, x.get("indexes", []))))


def object_store(key_path: str, name: str | None = None, auto_increment: bool = False):
    """Class decorator: a dataclass whose fields' metadata {"index": name or True, "unique": bool} become a StoreDef in
    the class's `store`. The name defaults to the class's, an index's to the field's."""

    def made(cls):
        store = StoreDef(name or cls.__name__, key_path, auto_increment)
        for f in fields(cls):
            if at := f.metadata.get("index"):
                store = store.with_index(f.name if at is True else at, f.metadata.get("path", f.name), bool(f.metadata.get("unique")), bool(f.metadata.get("multi_entry")))
        cls.store = store
        return cls

    return made


@dataclass(frozen=True)
class Config:
    default_ttl_s: int | None = None
    compaction_threshold: int = 4
    compaction_ratio: int = 4
    compression: str = "zstd"
    compression_level: int | None = None
    ts_bucket_us: int | None = None  # set: files are partitioned by floor(ts / width)
    manifest_snapshot_every: int = 500
    max_broadcast_ranges: int = 10_000
    max_broadcast_rows: int = 100_000  # newer entries whose keys are broadcast against a merged part
    max_broadcast_bytes: int = 16 << 20  # of such entries' files, and of range tombstones
    extra: dict = field(default_factory=dict)

    def validate(self) -> Config:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise InvalidConfig(what)

        need(self.default_ttl_s is None or 0 < self.default_ttl_s <= NEVER // 1_000_000, "default_ttl_s must be above 0 and not overflow")
        need(self.compaction_threshold >= 1, "compaction_threshold must be at least 1")
        need(self.compaction_ratio >= 1, "compaction_ratio must be at least 1")
        need(self.compression in ("none", "lz4_raw", "zstd", "snappy"), "compression must be none, lz4_raw, zstd or snappy")
        need(self.compression_level is None or 1 <= self.compression_level <= 22, "compression_level must be from 1 to 22")
        need(self.ts_bucket_us is None or self.ts_bucket_us > 0, "ts_bucket_us must be above 0")
        need(self.manifest_snapshot_every >= 1, "manifest_snapshot_every must be at least 1")
        need(min(self.max_broadcast_ranges, self.max_broadcast_rows, self.max_broadcast_bytes) >= 0, "bounds of what is broadcast can't be below 0")
        return self
