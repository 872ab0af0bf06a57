"""Paths into JSON documents, and an order across JSON types.

The order is null < false < true < integers < other numbers < integers beyond 64 bits signed < strings < arrays and
objects as text; so 1 and 1.0 differ. As Spark can't order VARIANT, a value becomes a struct whose lexicographic order is
this one. A path that leads nowhere gives SQL NULL, an explicit null its own key.
"""

from __future__ import annotations

import json
from itertools import product
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordspark.plans.model import NEVER, InvalidArgument

KEY_TYPE = "struct<tag:int,i:bigint,f:double,u:decimal(20,0),s:string>"


def json_paths(path: str) -> list[str]:
    """The forms a dotted path can mean: a numeric segment is an array's place or an object's key."""
    if path == "":
        return ["$"]
    each = [[f"[{x}]", f"['{x}']"] if x.isdigit() else [f"['{x}']"] for x in path.replace("'", "").split(".")]
    return ["$" + "".join(x) for x in product(*each)]


def extract(variant: Column, path: str) -> Column:
    """VARIANT at the path; NULL where it leads nowhere."""
    found = [F.try_variant_get(variant, p, "variant") for p in json_paths(path)]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def raw_text(doc: Column, path: str) -> Column:
    found = [F.get_json_object(doc, p) for p in json_paths(path)]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def sort_key(doc: Column, path: str) -> Column:
    """The orderable struct of the value at the path of a JSON text; NULL where it leads nowhere.

    The text is parsed once: the value, and then its kind, are bound as a lambda's variables. Only decimals, whose own text
    tells 7 from 7.0, are looked up a second time.
    """
    raw = raw_text(doc, path)

    def key(x: Column) -> Column:
        v, kind = x["v"], x["kind"]
        decimal = kind.startswith("DECIMAL")
        fraction = kind.isin("DOUBLE", "FLOAT") | (decimal & (raw.rlike("[.eE]") | raw.startswith("-")))
        whole = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT")
        number = F.when(whole, 4).when(fraction, 5).when(decimal, 6)
        other = F.when(kind == "VOID", 1).when(kind == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), 3).otherwise(2))
        return F.when(kind.isNull(), F.lit(None)).otherwise(F.struct(F.when(kind == "STRING", 7).otherwise(F.coalesce(number, other, F.lit(8))).alias("tag"), v.alias("v")))

    def parts(x: Column) -> Column:
        tag, v = x["tag"], x["v"]
        return F.when(
            tag.isNotNull(),
            F.struct(
                tag.cast("int").alias("tag"), F.when(tag == 4, F.try_variant_get(v, "$", "bigint")).alias("i"), F.when(tag == 5, F.try_variant_get(v, "$", "double")).alias("f"),
                F.when(tag == 6, F.try_variant_get(v, "$", "decimal(20,0)")).alias("u"), F.when(tag == 7, F.try_variant_get(v, "$", "string")).when(tag == 8, F.to_json(v)).alias("s"),
            ),
        )

    found = F.transform(F.array(extract(F.try_parse_json(doc), path)), lambda v: F.struct(v.alias("v"), F.schema_of_variant(v).alias("kind")))
    return F.transform(F.transform(found, key), parts)[0]


def order_key(value: Any) -> tuple:
    """The same order for Python values."""
    if value is None:
        return (1,)
    if isinstance(value, bool):
        return (3 if value else 2,)
    if isinstance(value, int) and -(1 << 63) <= value < 1 << 63:
        return (4, value)
    if isinstance(value, float) or isinstance(value, int) and not 0 <= value < 1 << 64:
        return (5, float(value))
    if isinstance(value, int):
        return (6, value)
    if isinstance(value, str):
        return (7, value.encode())
    return (8, json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode())


def literal_key(value: Any) -> Column:
    """The orderable struct of a Python value."""
    tag, *rest = order_key(value)
    at = {4: "i", 5: "f", 6: "u", 7: "s", 8: "s"}.get(tag)
    content = {at: rest[0].decode() if tag >= 7 else rest[0]} if at else {}
    kinds = {"i": "bigint", "f": "double", "u": "decimal(20,0)", "s": "string"}
    return F.struct(F.lit(tag).cast("int").alias("tag"), *[F.lit(content.get(k) if k != "u" or k not in content else str(content[k])).cast(t).alias(k) for k, t in kinds.items()])


def once(value: Column, use) -> Column:
    """use(value) with the value computed once, as a lambda's variable."""
    return F.transform(F.array(value), use)[0]


def may_equal(doc: Column, path: str, value: Any) -> Column | None:
    """A cheap condition on the JSON text that holds wherever the value at the path equals this one; None if there is none.
    First that the text holds the value's own, which needs no parsing (strings may be written with escapes), then that it
    stands at the path."""
    raw = raw_text(doc, path)
    if isinstance(value, bool):
        text = "true" if value else "false"
        return doc.contains(text) & (raw == text)
    if isinstance(value, str):
        return (doc.contains(value) | doc.contains("\\")) & (raw == value)
    if isinstance(value, int):
        return doc.contains(str(value)) & (raw.try_cast("bigint") == value if -(1 << 63) <= value < 1 << 63 else raw.isNotNull())
    return raw.isNotNull() if isinstance(value, float) else None


def may_be_between(doc: Column, path: str, low: Any, high: Any) -> Column | None:
    """As may_equal, of low <= value < high: between two integers are integers only, between two strings strings."""
    raw = raw_text(doc, path)
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and -(1 << 63) <= x < 1 << 63
    if whole(low) and whole(high):
        return once(raw.try_cast("bigint"), lambda x: x.between(low, high))
    return once(raw, lambda x: (x >= low) & (x < high)) if isinstance(low, str) and isinstance(high, str) else None


def pk_text(value: Any) -> str:
    """A primary key as text: 10 sorts before 2."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        if "\0" in value:
            raise InvalidArgument("a key can't hold NUL")
        return value
    if value is None:
        return "\0"
    if isinstance(value, (int, float)):
        return repr(value)
    return "￿" + json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def pk_column(c: Column) -> Column:
    """pk_text of a typed column."""
    return F.when(c.isNull(), F.lit("\0")).otherwise(c.cast("string"))


def multi_entry(array: Column) -> Column:
    """One entry for each different element."""
    return F.explode(F.array_distinct(array))


def with_ttl(ts: Column, ttl_s: int | None, expire_at: Column) -> Column:
    """ts + ttl, stopping at NEVER; without a ttl what the record says."""
    if ttl_s is None:
        return expire_at
    span = min(ttl_s * 1_000_000, NEVER)
    return F.when(ts > F.lit(NEVER - span), F.lit(NEVER)).otherwise(ts + F.lit(span))


def record_size(key: Column, value: Column, range_end: Column | None = None) -> Column:
    """Bytes of a change-log entry: its fixed fields and what varies."""
    fixed = F.lit(31) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))
    return fixed if range_end is None else fixed + F.coalesce(F.octet_length(range_end) + 2, F.lit(0))


def expire_ms(expire_at: Column) -> Column:
    return F.when(expire_at != F.lit(NEVER), F.floor(expire_at / 1000))


def key_text(key: Column) -> Column:
    """A binary key as text; bytes that aren't UTF-8 show as replacement characters."""
    return F.make_valid_utf8(key.cast("string"))
