"""visible() against a model in plain Python, and the decisions on single points."""

import random
import re

import pytest
from pyspark.sql import functions as F

from recordspark.operators import records
from recordspark.plans.model import NEVER, Bound, Op, ScanRange, changelog_schema


def log_of(spark, rows):
    """rows: (op, key, ts, value, expire_at, range_end); seq is the place."""
    return spark.createDataFrame([(k, ts, exp, bytearray(v or b""), i + 1, int(op), end) for i, (op, k, ts, v, exp, end) in enumerate(rows)], changelog_schema())


def put(k, ts, v=b"\1\2\3", exp=NEVER):
    return (Op.PUT, k, ts, v, exp, None)


def delete(k, ts):
    return (Op.DELETE, k, ts, None, NEVER, None)


def delete_range(a, b):
    return (Op.DELETE_RANGE, a, 0, None, NEVER, b)


def model(rows, now, snapshot=None):
    live, ranges = {}, []
    for seq, (op, k, ts, v, exp, end) in enumerate(rows, 1):
        if snapshot is not None and seq > snapshot:
            break
        if op == Op.DELETE_RANGE:
            ranges.append((k, end, seq))
        else:
            live[k, ts] = (op, v, exp, seq)
    return sorted(
        (k, ts, bytes(v)) for (k, ts), (op, v, exp, seq) in live.items() if op == Op.PUT and exp > now and not any(a <= k < b and s > seq for a, b, s in ranges)
    )


def seen(df):
    return [(r.key, r.ts, bytes(r.value)) for r in records.in_order(df).collect()]


@pytest.mark.parametrize("seed", range(6))
def test_equals_the_model(spark, seed):
    rnd = random.Random(seed)
    key = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4)))
    rows = []
    for _ in range(300):
        kind = rnd.random()
        if kind < 0.75:
            rows.append(put(key(), rnd.randint(0, 5), rnd.randbytes(rnd.randint(0, 8)), rnd.choice([NEVER, 50, 150])))
        elif kind < 0.92:
            rows.append(delete(key(), rnd.randint(0, 5)))
        else:
            a, b = sorted((key(), key()))
            rows.append(delete_range(a, b))
    df = log_of(spark, rows)
    for snapshot in (None, 120):
        assert seen(records.visible(df, 100, snapshot)) == model(rows, 100, snapshot)
        assert seen(records.visible(df, 100, snapshot, max_broadcast=1)) == model(rows, 100, snapshot)
    want = [x for x in model(rows, 100) if x[0].startswith("a") and 1 <= x[1] <= 3]
    assert seen(records.scan(df, ScanRange.prefix_time_range("a", 1, 3), 100)) == want
    newest = {}
    for k, ts, v in model(rows, 100):
        newest[k] = (k, ts, v)
    assert seen(records.latest(records.visible(df, 100))) == sorted(newest.values())


def test_ranges_of_scans(spark):
    df = log_of(spark, [put("a", 100), put("b", 200), put("c", 300), put("d", 400)])
    keys = lambda at: [k for k, _, _ in seen(records.scan(df, at, 0))]
    assert keys(ScanRange.key_range("b", "c")) == ["b", "c"]
    assert keys(ScanRange.time_range(150, 300)) == ["b", "c"]
    assert keys(ScanRange.of_prefix("")) == keys(ScanRange.all()) == ["a", "b", "c", "d"]
    assert keys(ScanRange(key_low=Bound("a", False), key_high=Bound("c"))) == ["b", "c"]
    assert keys(ScanRange(key_low=Bound("a"), key_high=Bound("c", False))) == ["a", "b"]
    assert keys(ScanRange(ts_low=Bound(200, False))) == ["c", "d"]
    assert keys(ScanRange(ts_high=Bound(200))) == ["a", "b"]


def test_range_tombstones_hide_only_what_came_before(spark):
    rows = [put("a", 1), put("b", 1), put("c", 1), delete_range("b", "d"), put("b", 1, b"new")]
    assert seen(records.visible(log_of(spark, rows), 0)) == [("a", 1, b"\1\2\3"), ("b", 1, b"new")]


def test_range_tombstone_applies_though_it_starts_outside_the_scan(spark):
    rows = [put("x-a", 1), put("x-c", 1), delete_range("w", "x-b")]
    assert [k for k, _, _ in seen(records.scan(log_of(spark, rows), ScanRange.of_prefix("x-"), 0))] == ["x-c"]
    assert records.get(log_of(spark, rows), "x-a", 1, 0).isEmpty()


def test_expired_newest_version_hides_an_older_one(spark):
    rows = [put("k", 1, b"old"), put("k", 1, b"new", 10)]
    assert seen(records.visible(log_of(spark, rows), 10)) == []
    assert seen(records.visible(log_of(spark, rows), 9)) == [("k", 1, b"new")]


def test_latest(spark):
    df = log_of(spark, [put("k", 100), put("k", 300), put("k", 200), put("l", 500), delete("l", 500)])
    assert records.get_latest(df, "k", 0).first()["ts"] == 300
    assert records.get_latest(df, "l", 0).isEmpty() and records.get_latest(df, "m", 0).isEmpty()


def test_binary_keys_are_in_unsigned_byte_order(spark):
    from pyspark.sql import types as T

    rows = [(bytearray(k), 1, NEVER, bytearray(b""), i, 0, None) for i, k in enumerate((b"\x80", b"\x7f", b"\xff\x01", b"a"))]
    df = spark.createDataFrame(rows, changelog_schema(T.BinaryType()))
    assert [bytes(r.key) for r in records.in_order(records.visible(df, 0)).collect()] == [b"a", b"\x7f", b"\x80", b"\xff\x01"]
    assert [bytes(r.key) for r in records.scan(df, ScanRange.of_prefix(b"\xff"), 0).collect()] == [b"\xff\x01"]


def test_empty_log(spark):
    df = log_of(spark, [])
    assert seen(records.visible(df, 0)) == [] and records.latest(records.visible(df, 0)).isEmpty()


def test_time_buckets_round_toward_zero(spark):
    got = {r.bucket: r.n for r in records.time_buckets(log_of(spark, [put("a", -5), put("b", 5), put("c", 15)]), 10).collect()}
    assert got == {0: 2, 1: 1}


@pytest.mark.parametrize("max_bytes", [0, 1 << 20])
def test_many_ranges_over_keys_with_one_head(spark, max_bytes):
    """Against every pair, with ranges that nest, overlap, touch, cover nothing, or have no end."""
    rnd = random.Random(3)
    key = lambda: f"user:{rnd.randint(0, 3000):05d}"
    rows = [(key(), rnd.randint(0, 1000)) for _ in range(4000)]
    ranges = [(key(), key() if rnd.random() < 0.995 else None, rnd.randint(0, 200)) for _ in range(300)] + [("user:00010", "user:00010", 999), ("user:02990", None, 500), ("", "user:00020", 700)]
    want = sorted(r for r in rows if not any(a <= r[0] and (b is None or r[0] < b) and at > r[1] for a, b, at in ranges))
    df, spans = spark.createDataFrame(rows, "key string, seq long"), spark.createDataFrame(ranges, "low string, high string, at long")
    out = records.without_ranges(df, spans, max_broadcast=10, max_bytes=max_bytes)
    assert sorted(map(tuple, out.collect())) == want and 0 < len(want) < len(rows)
    assert sorted(map(tuple, records.without_ranges(df, spans).collect())) == want
    assert not re.search("CartesianProduct|NestedLoop", out._jdf.queryExecution().toString())


def test_no_job_looks_for_ranges_that_a_manifest_denies(spark):
    df = spark.createDataFrame([("a", 1)], "key string, seq long")
    assert records.without_ranges(df, df.where(F.raise_error(F.lit("read")).isNotNull()), known=0) is df
