"""Reads of document stores: scans, filters, order, pages, indexes, cursors, counts.

A store is a DataFrame with a text primary key `pk` and either a JSON text column (dynamic: values have the order across
types of functions.paths) or typed columns (the columns' own order). Everything is a lazy DataFrame; filters on typed
columns reach the Parquet scan, order with limit is a top-k. An index is a promise about values, not a structure that
must be read: only the explicit index reads are sparse (documents that lack one of an index's paths aren't in it).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordspark.functions import paths
from recordspark.operators.ordering import with_ordinals
from recordspark.plans.model import NEVER, IndexDef, InvalidArgument, KeyRange, StoreDef, conjunction


class Direction(Enum):
    NEXT = "next"
    PREV = "prev"
    NEXT_UNIQUE = "nextunique"
    PREV_UNIQUE = "prevunique"

    @classmethod
    def parse(cls, text: str) -> Direction:
        try:
            return cls(text.lower())
        except ValueError:
            raise InvalidArgument(f"invalid direction {text!r}") from None

    @property
    def down(self) -> bool:
        return self in (Direction.PREV, Direction.PREV_UNIQUE)

    @property
    def unique(self) -> bool:
        return self in (Direction.NEXT_UNIQUE, Direction.PREV_UNIQUE)


@dataclass(frozen=True)
class Documents:
    df: DataFrame
    store: StoreDef
    doc: str | None = None  # the JSON column; None: typed columns
    pk: str = "pk"

    @classmethod
    def typed(cls, df: DataFrame, store: StoreDef) -> Documents:
        """Of a table: pk is the text of its key column."""
        return cls(df.withColumn("pk", paths.pk_column(F.col(store.key_path))), store)

    def key(self, path: str) -> Column:
        """What the value at the path is compared and ordered by."""
        return F.col(path) if self.doc is None else paths.sort_key(F.col(self.doc), path)

    def literal(self, value: Any) -> Column:
        return F.lit(value) if self.doc is None else paths.literal_key(value)

    def equals(self, path: str, value: Any) -> Column:
        """An explicit null equals null; what is missing equals nothing (a typed column can't tell the two apart)."""
        if value is None and self.doc is None:
            return F.col(path).isNull()
        exact = self.key(path) == self.literal(value)
        first = None if self.doc is None else paths.may_equal(F.col(self.doc), path, value)
        return exact if first is None else F.coalesce(first, F.lit(False)) & exact  # most rows end at the cheap one

    def between(self, path: str, low: Any, high: Any) -> Column:
        """low <= value < high."""
        inside = lambda k: (k >= self.literal(low)) & (k < self.literal(high))
        if self.doc is None:
            return inside(F.col(path))
        exact = paths.once(self.key(path), inside)
        first = paths.may_be_between(F.col(self.doc), path, low, high)
        return exact if first is None else F.coalesce(first, F.lit(False)) & exact

    def with_df(self, df: DataFrame) -> Documents:
        return replace(self, df=df)

    # Scans and counts

    def scan(self) -> DataFrame:
        return self.df.orderBy(self.pk)

    def scan_with_meta(self) -> DataFrame:
        """With _tsMs and _expireAtMs (null: never); needs the columns ts and expire_at."""
        return self.df.withColumn("_tsMs", F.expr("ts div 1000")).withColumn("_expireAtMs", F.when(F.col("expire_at") != F.lit(NEVER), F.expr("expire_at div 1000"))).orderBy(self.pk)

    def get(self, key: Any) -> DataFrame:
        return self.df.where(F.col(self.pk) == paths.pk_text(key))

    def get_key(self, key: Any) -> DataFrame:
        return self.get(key).select(self.pk).limit(1)

    def in_range(self, at: KeyRange | None) -> DataFrame:
        """By primary key, in the order of text."""
        return self.df if at is None or at.is_unbounded else self.df.where(at.predicate(F.col(self.pk), lambda v: F.lit(paths.pk_text(v))))

    def get_all(self, at: KeyRange | None = None, count: int | None = None) -> DataFrame:
        rows = self.in_range(at).orderBy(self.pk)
        return rows if count is None else rows.limit(count)

    def get_all_keys(self, at: KeyRange | None = None, count: int | None = None) -> DataFrame:
        rows = self.in_range(at).select(self.pk).orderBy(self.pk)
        return rows if count is None else rows.limit(count)

    def count(self, at: KeyRange | None = None) -> DataFrame:
        return self.in_range(at).agg(F.count("*").alias("n"))

    def query(self) -> QueryBuilder:
        return QueryBuilder(self)

    def decoded(self, schema: T.StructType) -> DataFrame:
        """The JSON documents as columns; one that doesn't fit is an error."""
        return self.df.select(self.pk, F.from_json(self.doc, schema, {"mode": "FAILFAST"}).alias("_d")).select(self.pk, "_d.*")

    # Indexes

    def entries(self, index: IndexDef) -> tuple[DataFrame, list[str]]:
        """The documents that are in the index, with a column for each of its paths."""
        names = [f"_k{i}" for i in range(len(index.key_paths))]
        df = self.df
        if index.multi_entry and len(names) == 1:
            path = index.key_paths[0]
            if self.doc is None:
                return df.withColumn("_k0", paths.multi_entry(F.col(path))), names
            v = paths.extract(F.try_parse_json(self.doc), path)
            several = F.from_json(F.to_json(v), "array<variant>")
            each = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.transform(several, lambda x: F.to_json(x))).when(v.isNotNull(), F.array(F.to_json(v)))
            df = df.withColumn("_e", F.explode(F.array_distinct(each)))
            return df.withColumn("_k0", paths.sort_key(F.concat(F.lit('{"e":'), "_e", F.lit("}")), "e")).drop("_e"), names
        for name, path in zip(names, index.key_paths):
            df = df.withColumn(name, self.key(path))
        return df.where(conjunction([F.col(n).isNotNull() for n in names])), names

    def from_index(self, index: str, keep, with_keys: bool = False) -> DataFrame:
        rows, names = self.entries(self.store.index(index))
        rows = rows.where(keep(names)).orderBy(*names, self.pk)
        return rows if with_keys else rows.drop(*names)

    def get_by_index(self, index: str, value: Any) -> DataFrame:
        """value: the first path's, or a list for the leading paths."""
        values = value if isinstance(value, (list, tuple)) else [value]
        return self.from_index(index, lambda names: conjunction([F.col(n) == self.literal(v) for n, v in zip(names, values)]))

    def range_by_index(self, index: str, low: Any, high: Any) -> DataFrame:
        """low <= value < high; lists for the leading paths."""
        low, high = ([x] if not isinstance(x, (list, tuple)) else list(x) for x in (low, high))

        def keep(names: list[str]) -> Column:
            at = lambda n: F.struct(*[F.col(x).alias(x) for x in names[:n]])
            lit = lambda values: F.struct(*[self.literal(v).alias(x) for x, v in zip(names, values)])
            if len(low) == len(high) == 1:
                return (F.col(names[0]) >= self.literal(low[0])) & (F.col(names[0]) < self.literal(high[0]))
            return (at(len(low)) >= lit(low)) & (at(len(high)) < lit(high))

        return self.from_index(index, keep)

    def index_in(self, index: str, at: KeyRange | None) -> DataFrame:
        """The index's documents with their keys, of those whose first key is in the range."""
        return self.from_index(index, lambda names: F.lit(True) if at is None else at.predicate(F.col(names[0]), self.literal), with_keys=True)

    def violations(self, index: str) -> DataFrame:
        """Index keys that several documents have: key columns and n."""
        rows, names = self.entries(self.store.index(index))
        return rows.groupBy(*names).agg(F.count_distinct(F.col(self.pk)).alias("n")).where("n > 1")

    # Cursors

    def cursor(self, at: KeyRange | None = None, direction: Direction = Direction.NEXT) -> Cursor:
        rows = self.in_range(at)
        if direction.unique:
            w = Window.partitionBy(self.pk).orderBy(F.lit(0))
            rows = rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
        return Cursor(rows, (self.pk,), direction.down)

    def index_cursor(self, index: str, at: KeyRange | None = None, direction: Direction = Direction.NEXT, unique_on: str = "pk") -> Cursor:
        """Rows have the index keys in _k0, _k1, ... unique_on: "pk" (a document shows once) or "index_key"."""
        rows = self.index_in(index, at)
        names = [c for c in rows.columns if c.startswith("_k")]
        cursor = Cursor(rows, (*names, self.pk), direction.down)
        if direction.unique:
            first = Window.partitionBy(*([self.pk] if unique_on == "pk" else names)).orderBy(*cursor.order)
            cursor.rows = rows.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
        return cursor


def literal_of(value: Any, kind: T.DataType) -> Column:
    """A value of a row, structs too, as a literal of its type."""
    if value is not None and isinstance(kind, T.StructType):
        return F.struct(*[literal_of(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return F.lit(value).cast(kind)


@dataclass
class Cursor:
    """An ordered result and a place in it.

    What comes next is read by key: the rows after the last one that was fetched, of which a page is a top-k. So a walk over
    n rows costs n / `page` reads, each of which the scan can filter by key, not n sorts of everything. Rows of equal keys
    are told apart by a hash of their columns, and rows that are equal altogether by how many were given.
    """

    rows: DataFrame
    by: tuple[str, ...]  # the columns of the order
    down: bool = False
    page: int = 1000
    at: int = 0  # rows before the place
    last: tuple | None = None  # the order's values, and the hash, of the last row that fetch() gave
    skip: int = 0  # rows from there on (the given ones with these values, and what advance() has passed)
    ahead: list = field(default_factory=list)  # read after `last`, not given yet

    @property
    def order(self) -> tuple[Column, ...]:
        return tuple(F.col(c).desc() if self.down else F.col(c).asc() for c in self.by)

    def to_df(self) -> DataFrame:
        return self.rows.orderBy(*self.order)

    def with_ordinals(self) -> DataFrame:
        return with_ordinals(self.rows, *self.order)

    def _from_last(self) -> DataFrame:
        """In order, with the hash as _tie: the rows not before the last that was fetched."""
        told = [f.name for f in self.rows.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        rows = self.rows.withColumn("_tie", F.xxhash64(*told))
        if self.last is not None:
            *values, tie = self.last
            later = F.col("_tie") >= F.lit(tie)
            for name, value in reversed(list(zip(self.by, values))):
                c, v = F.col(name), literal_of(value, self.rows.schema[name].dataType)
                if value is None:  # nulls come first upwards and last downwards
                    beyond = F.lit(False) if self.down else c.isNotNull()
                else:
                    beyond = F.coalesce(c < v, F.lit(True)) if self.down else F.coalesce(c > v, F.lit(False))
                later = beyond | (c.eqNullSafe(v) & later)
            rows = rows.where(later)
        return rows.orderBy(*self.order, "_tie")

    def advance(self, n: int) -> DataFrame:
        """Skips n rows and gives the next (no row at the end), lazily."""
        out = self._from_last().offset(self.skip + n).limit(1).drop("_tie")
        self.skip, self.at, self.ahead = self.skip + n + 1, self.at + n + 1, []
        return out

    def next_value(self) -> DataFrame:
        return self.advance(0)

    def fetch(self, n: int) -> list[Row]:
        """The next n rows (fewer at the end); whole pages are read ahead."""
        out: list = []
        row, places = Row(*self.rows.columns), [self.rows.columns.index(c) for c in self.by]
        while len(out) < n:
            if not self.ahead:
                self.ahead = self._from_last().offset(self.skip).limit(max(self.page, n - len(out))).collect()
                if not self.ahead:
                    break
            part = self.ahead[: n - len(out)]
            self.ahead = self.ahead[len(part) :]
            for r in part:
                key = (*(r[i] for i in places), r[-1])
                self.skip = self.skip + 1 if key == self.last else 1
                self.last = key
            out += [row(*r[:-1]) for r in part]
        self.at += len(out)
        return out

    def __iter__(self):
        while row := self.fetch(1):
            yield row[0]

    def current(self) -> DataFrame:
        """The row given last, without moving."""
        return self.to_df().offset(max(0, self.at - 1)).limit(1 if self.at else 0)

    def remaining(self) -> int:
        return max(0, self.rows.count() - self.at)


@dataclass(frozen=True)
class QueryBuilder:
    """filter, then sort, then offset, then limit."""

    docs: Documents
    filters: tuple[Column, ...] = ()
    order: tuple[Column, ...] = ()
    first: int | None = None
    skip: int = 0
    extra: dict = field(default_factory=dict)

    def _and(self, c: Column) -> QueryBuilder:
        return replace(self, filters=(*self.filters, c))

    def where_eq(self, path: str, value: Any) -> QueryBuilder:
        return self._and(self.docs.equals(path, value))

    def where_range(self, path: str, low: Any, high: Any) -> QueryBuilder:
        """low <= value < high."""
        return self._and(self.docs.between(path, low, high))

    def where_in(self, path: str, values: list[Any]) -> QueryBuilder:
        return self._and(reduce(lambda a, b: a | b, [self.docs.equals(path, v) for v in values]) if values else F.lit(False))

    def order_by(self, path: str, descending: bool = False) -> QueryBuilder:
        """What is missing counts as the smallest; ties are in the order of the primary key."""
        k = self.docs.key(path)
        return replace(self, order=(k.desc_nulls_last() if descending else k.asc_nulls_first(), F.col(self.docs.pk).asc()))

    def limit(self, n: int) -> QueryBuilder:
        return replace(self, first=n)

    def offset(self, n: int) -> QueryBuilder:
        return replace(self, skip=n)

    def to_df(self) -> DataFrame:
        df = self.docs.df.where(conjunction(list(self.filters))) if self.filters else self.docs.df
        df = df.orderBy(*(self.order or (F.col(self.docs.pk).asc(),)))
        df = df.offset(self.skip) if self.skip else df
        return df if self.first is None else df.limit(self.first)

    def collect(self) -> list:
        return self.to_df().collect()

    def count(self) -> int:
        return (self.docs.df.where(conjunction(list(self.filters))) if self.filters else self.docs.df).count()
