"""Sharding by minimax contiguous partition. DataFrame functions; the binary search runs on bounded sums on the driver.

Documents with equal texts are one atomic group. Groups stand in the order of the text's MD5. The smallest capacity at
which `shards` contiguous runs of groups suffice is found by binary search, each capacity checked greedily; the cuts
then keep below that capacity and as near to equal as they can.

At scale: groups are never listed on the driver. It holds sums over prefixes of the MD5 (65,536 at first). Where a
prefix that holds several groups meets a cut, or blocks the next smaller capacity, that prefix alone is split by three
more hex digits, until all such places are single groups; so the capacity is exact over single groups though the driver
never holds more than some ten thousand sums. Slots come from counts by (shard, cell of the id), so neither a shard nor
a group of copies has to meet in one task. Texts are read once and never shuffled.

Defined results: null text counts 0 bytes and is in a group with the empty text; repeated rows each take a slot; an
empty table gives an empty result; a group larger than the mean makes its shard that large; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

FIRST_DIGITS, MORE_DIGITS, CELLS = 4, 3, 1024
PAST_ALL = "g"  # sorts after every hex text


def greedy(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """The cuts that fill shard after shard up to capacity; None if the items don't fit. ends: running sums from 0."""
    cuts, at = [0], 0
    for _ in range(shards):
        at = int(np.searchsorted(ends, ends[at] + capacity, side="right")) - 1
        cuts.append(at)
    return cuts if at == len(ends) - 1 else None


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    ends = np.concatenate([[0], np.cumsum(sizes)])
    low, high = int(max(sizes.max(initial=0), -(-int(ends[-1]) // shards))), int(ends[-1])
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy(ends, mid, shards) else (mid + 1, high)
    return low


def even_cuts(sizes: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Cuts with no shard above capacity, each as near as can be to an equal share of what is left."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    least = [len(sizes)]  # from the back: the first place from which the shards left suffice
    for _ in range(shards):
        least.append(int(np.searchsorted(ends, ends[least[-1]] - capacity, side="left")))
    least.reverse()
    cuts = [0]
    for i in range(1, shards):
        at = cuts[-1]
        want = ends[at] + (ends[-1] - ends[at]) / (shards - i + 1)
        j = int(np.searchsorted(ends, want))
        j = j - 1 if j > at and (j > len(sizes) or want - ends[j - 1] <= ends[j] - want) else j
        most = int(np.searchsorted(ends, ends[at] + capacity, side="right")) - 1
        cuts.append(min(max(j, least[i], at), most))
    return [*cuts, len(sizes)]


def blocked_at(sizes: np.ndarray, capacity: int, shards: int) -> set[int]:
    """The items that don't fit any more where the greedy filling ends a shard."""
    ends, at, out = np.concatenate([[0], np.cumsum(sizes)]), 0, set()
    for _ in range(shards):
        at = int(np.searchsorted(ends, ends[at] + capacity, side="right")) - 1
        if at < len(sizes):
            out.add(at)
    return out


def cut_points(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """groups: key (hex), bytes. Returns where each shard but the first begins, and the smallest capacity."""

    def sums(at: DataFrame, digits: int) -> list[tuple[str, int, int]]:
        got = at.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("groups"))
        return [(r.prefix, int(r.bytes), int(r.groups)) for r in got.toPandas().itertuples()]

    items = sorted(sums(groups, FIRST_DIGITS))
    while True:
        sizes = np.array([x[1] for x in items], dtype=np.int64)
        capacity = smallest_capacity(sizes, shards)
        cuts = even_cuts(sizes, capacity, shards)
        met = blocked_at(sizes, capacity - 1, shards) | {j for c in cuts for j in (c - 1, c)}
        open_ = {j for j in met if 0 <= j < len(items) and items[j][2] > 1}
        if not open_:
            return [items[c][0] if c < len(items) else PAST_ALL for c in cuts[1:-1]], capacity
        by_length: dict[int, list[str]] = {}
        for j in open_:
            by_length.setdefault(len(items[j][0]), []).append(items[j][0])
        finer = [x for n, prefixes in by_length.items() for x in sums(groups.where(F.substring("key", 1, n).isin(prefixes)), n + MORE_DIGITS)]
        items = sorted([x for j, x in enumerate(items) if j not in open_] + finer)


def shard(docs: DataFrame, shards: int = 24, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, size, text_crc32, shard, slot."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(raw).cast("long") + overhead).alias("size"),
            F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("key"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    if rows.isEmpty():
        starts = [PAST_ALL] * (shards - 1)
    else:
        starts, _ = cut_points(stored(groups, "shard-groups"), shards)
    number = sum((F.when(F.col("key") >= F.lit(s), 1).otherwise(0) for s in starts), F.lit(0)).cast("int")
    rows = rows.withColumn("shard", number).withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("shard", "cell").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    in_cell = Window.partitionBy("shard", "cell").orderBy("doc_id", "key")
    return (
        rows.withColumn("place", F.row_number().over(in_cell) - 1).join(cells, ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"))
    )
