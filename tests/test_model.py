"""Stated things: ranges, stores, configuration, the order across types."""

from dataclasses import dataclass, field

import pytest
from hypothesis import given
from hypothesis import strategies as st

from recordspark.functions.paths import literal_key, order_key, pk_text, sort_key
from recordspark.operators.documents import Direction
from recordspark.plans.model import AlreadyExists, Config, InvalidArgument, InvalidConfig, KeyRange, NotFound, StoreDef, object_store


@given(st.integers(-30, 30), st.integers(-30, 30), st.booleans(), st.booleans())
def test_key_range_includes(low, high, low_open, high_open):
    """As plain comparisons say, of whole numbers around the bounds."""
    for x in range(-32, 33):
        above, below = (x > low if low_open else x >= low), (x < high if high_open else x <= high)
        assert KeyRange.bound(low, high, low_open, high_open).includes(x) == (above and below)
        assert KeyRange.lower_bound(low, low_open).includes(x) == above and KeyRange.upper_bound(high, high_open).includes(x) == below
        assert KeyRange.only(low).includes(x) == (x == low)


def test_key_range_across_types():
    assert KeyRange().is_unbounded and all(KeyRange().includes(x) for x in (None, "", -1e9, [0]))
    assert not KeyRange.bound(-2, 2).includes(0.25) and not KeyRange.bound(-2, 2).includes("0")  # whole numbers are apart from others
    assert KeyRange.lower_bound(10**6).includes(0.25) and KeyRange.upper_bound("z").includes(10**6)


#: By the documented order: null, false, true, whole numbers, other numbers, whole ones beyond 64 bits, strings, the rest as text.
ORDERED = [None, False, True, *(s * 7**n for s, n in ((-1, 9), (-1, 2), (-1, 0), (0, 0), (1, 0), (1, 3), (1, 20))), *(x / 8 for x in (-900, -8, -3, 0, 5, 8, 5000)), (1 << 63) + 77, *(w * n for w, n in (("", 1), ("Z", 1), ("ab", 2), ("b", 1), ("ß", 1), ("𝄞", 1))), [3], [None], {"k": []}]


def test_order_across_types():
    assert sorted(ORDERED[::-1], key=order_key) == sorted(ORDERED, key=order_key)
    assert [order_key(x) for x in ORDERED] == sorted(order_key(x) for x in ORDERED)


def test_sort_key_orders_json_as_python_does(spark):
    import json

    from pyspark.sql import functions as F

    rows = [(i, json.dumps({"a": {"b": x}})) for i, x in enumerate(ORDERED)] + [(99, "{}"), (98, "not json")]
    df = spark.createDataFrame(rows, "i int, doc string").withColumn("k", sort_key(F.col("doc"), "a.b"))
    assert [r.i for r in df.where("k is not null").orderBy("k").collect()] == list(range(len(ORDERED)))
    assert {r.i for r in df.where("k is null").collect()} == {98, 99}
    for i, x in enumerate(ORDERED[:-2]):
        assert [r.i for r in df.where(F.col("k") == literal_key(x)).collect()] == [i]


def test_paths_into_arrays_and_objects(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([('{"user":{"name":"Alice","tags":["a","b"],"0":"zero"}}',)], "doc string")
    got = df.select(*[sort_key(F.col("doc"), p)["s"].alias(n) for n, p in (("name", "user.name"), ("tag", "user.tags.0"), ("zero", "user.0"), ("none", "user.x"))]).first()
    assert (got["name"], got["tag"], got["zero"], got["none"]) == ("Alice", "a", "zero", None)


@given(st.lists(st.one_of(st.none(), st.booleans(), st.integers(-(1 << 62), 1 << 63), st.floats(allow_nan=False), st.text()), max_size=12))
def test_order_is_total(values):
    keys = sorted(map(order_key, values))
    assert all(a <= b for a, b in zip(keys, keys[1:]))


def test_primary_keys_are_text():
    assert [pk_text(x) for x in ("x", 10, True, None)] == ["x", "10", "true", "\0"]
    assert pk_text(10) < pk_text(2) and pk_text(-5) == "-5"
    with pytest.raises(InvalidArgument):
        pk_text("a\0b")


def test_stores():
    s = StoreDef("users", "id").with_index("by_email", "email", unique=True).with_index("by_city_age", ["city", "age"])
    assert StoreDef.from_json(s.to_json()) == s and s.index("by_email").unique
    assert StoreDef.from_json({"name": "a", "key_path": "id", "indexes": [{"name": "i", "key_path": "x"}]}).index("i").key_paths == ("x",)
    with pytest.raises(AlreadyExists, match="already exists"):
        s.with_index("by_email", "x")
    with pytest.raises(NotFound, match="not found"):
        s.index("none")
    for bad in ("", "a b", "x" * 256):
        with pytest.raises(InvalidArgument):
            StoreDef(bad, "id")
    with pytest.raises(InvalidArgument):
        StoreDef("a", "x.y", auto_increment=True)


def test_object_store_decorator():
    @object_store("id")
    @dataclass
    class Users:
        id: str
        email: str = field(metadata={"index": "by_email", "unique": True}, default="")
        age: int = field(metadata={"index": True}, default=0)

    assert Users.store == StoreDef("Users", "id").with_index("by_email", "email", unique=True).with_index("age", "age")


@pytest.mark.parametrize("bad", [{"default_ttl_s": 0}, {"default_ttl_s": 1 << 62}, {"compaction_threshold": 0}, {"compression_level": 23}, {"compression": "x"}, {"ts_bucket_us": 0}, {"manifest_snapshot_every": 0}])
def test_config_is_checked(bad):
    with pytest.raises(InvalidConfig):
        Config(**bad).validate()


def test_directions():
    assert Direction.parse("PrevUnique") is Direction.PREV_UNIQUE
    with pytest.raises(InvalidArgument):
        Direction.parse("up")


def test_scalar_functions(spark):
    from pyspark.sql import functions as F

    from recordspark.functions import paths
    from recordspark.plans.model import NEVER

    df = spark.createDataFrame([(bytearray(b"a\xffb"), 5, NEVER), (bytearray("é".encode()), NEVER - 1, 7_000)], "key binary, ts long, expire_at long")
    got = df.select(
        paths.key_text(F.col("key")).alias("text"), paths.with_ttl(F.col("ts"), 2, F.col("expire_at")).alias("ttl"), paths.with_ttl(F.col("ts"), None, F.col("expire_at")).alias("kept"),
        paths.expire_ms(F.col("expire_at")).alias("ms"), paths.record_size(F.col("key"), F.lit(None).cast("binary"), F.col("key")).alias("size"),
    ).collect()
    assert [tuple(r) for r in got] == [("a�b", 2_000_005, NEVER, None, 31 + 3 + 5), ("é", NEVER, 7_000, 7, 31 + 2 + 4)]
