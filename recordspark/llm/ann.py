"""Nearest neighbours by inner product with a vantage-point tree for each shard.

A shard's vectors get one more component that makes their norms equal, so that the largest inner product is the smallest
Euclidean distance, a metric. A tree splits them at the median distance from vantage points down to leaves and keeps
the smallest and largest distance of each half. For a block of queries the triangle inequality gives each leaf a lower
bound; the leaves with the least bounds are searched first, then each leaf whose bound times `factor` doesn't exceed
the query's distance to its k-th found. Factor 1 is exact search; a larger one prunes more and may miss some.
A query keeps SPARE vectors beyond the k-th; where they all tie with it, within rounding, its leaves are searched again
for every vector that reaches the k-th score, so that the smaller ids win however many tie.
Trees and bounds are made of the vectors scaled by a power of two, which changes no order; scores are computed from the
original vectors in double precision, component after component.

At scale: vectors are dealt to shards of at most `most_bytes`, a query goes to each shard. A shard and the queries meet in
one stream, sorted so that the shard's vectors come first: each vector moves once, the tree is built where it is searched,
and the queries are searched in blocks of `block_rows` as they stream past, so a task holds a shard, its tree and a block,
whatever the table's size. Rows of one id are spread over the shards too. Copies of a vector collapse within a shard to
their k + 1 smallest ids, which loses nothing as ties go to the smaller id. A query's k nearest of each shard then meet in a
window that Spark limits on the map side.

Defined results: vectors that are null, empty, all zero, or hold null or non-finite components take no part, neither
as query nor as candidate; vectors of different lengths are not compared; a query is never its own neighbour (rows
that repeat its id neither). An id that several query rows have is one query, of its least vector (first by the first
component, and so on); candidate rows that repeat count each. With fewer than k candidates all are returned. Scores beyond
double precision are infinite. Further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAF, SPARE, TIED = 128, 12, 64


def lifted(x: np.ndarray) -> np.ndarray:
    """With one more component, so that all norms are that of the longest."""
    square = (x * x).sum(axis=1)
    return np.concatenate([x, np.sqrt(np.maximum(0, square.max() - square))[:, None]], axis=1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Divided by the power of two that brings the largest component (of each row, for queries) below 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def build(vectors: np.ndarray, ids: np.ndarray, keep: int) -> dict:
    """A tree of distinct vectors (doubles), each with its `keep` smallest ids."""
    order = np.argsort(ids, kind="stable")
    vectors, ids = np.ascontiguousarray(vectors[order]), ids[order]
    _, first, which = np.unique(vectors.view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    by = np.argsort(which, kind="stable")
    rank = np.arange(len(by)) - np.searchsorted(which[by], which[by])
    by = by[rank < keep]
    owner, own_ids = which[by], ids[by]
    vectors = vectors[first]
    x = lifted(scaled(vectors.reshape(1, -1)).reshape(vectors.shape))
    rng, perm = np.random.default_rng(len(x)), np.arange(len(x))
    points, bounds, children, leaves = [], [], [], []  # of inner nodes; leaves as ranges of perm
    todo = [(0, len(x), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        if b - a <= LEAF:
            here = -len(leaves) - 1
            leaves.append((a, b))
        else:
            here, own = len(points), perm[a:b]
            tried = rng.choice(own, 4, replace=False)
            far = np.linalg.norm(x[own[:256], None, :] - x[None, tried], axis=2)
            point = tried[int(np.argmax(far.std(axis=0)))]  # the one that tells the others apart best
            d = np.linalg.norm(x[own] - x[point], axis=1)
            by_d, mid = np.argsort(d, kind="stable"), (b - a) // 2
            perm[a:b], d = own[by_d], d[by_d]
            points.append(int(point))
            bounds.append((d[0], d[mid - 1], d[mid], d[-1]))
            children.append([0, 0])
            todo += [(a, a + mid, here, 0), (a + mid, b, here, 1)]
        if parent >= 0:
            children[parent][side] = here
    # ids of each vector in perm's order
    start = np.searchsorted(owner, np.arange(len(x) + 1))
    id_lists = [own_ids[start[p] : start[p + 1]] for p in perm]
    return {
        "vectors": vectors[perm], "scaled": x[perm, :-1], "extra": x[perm, -1], "ids": np.concatenate(id_lists), "id_ends": np.cumsum([0, *map(len, id_lists)]),
        "points": x[points] if points else np.empty((0, x.shape[1])), "bounds": np.array(bounds).reshape(-1, 4), "children": np.array(children, dtype=np.int64).reshape(-1, 2), "leaves": np.array(leaves),
    }


def leaf_bounds(tree: dict, queries: np.ndarray) -> np.ndarray:
    """For each query and leaf, a distance that no vector of the leaf is below. queries have the extra component 0."""
    n = len(tree["leaves"])
    out = np.zeros((len(queries), n))
    if not len(tree["points"]):
        return out
    p = tree["points"]
    d = np.sqrt(np.maximum(0, (queries**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * queries @ p.T))
    bound = {0: np.zeros(len(queries))}
    for node in range(len(p)):  # a parent comes before its children
        above, dq = bound.pop(node), d[:, node]
        for side in (0, 1):
            low, high = tree["bounds"][node, 2 * side : 2 * side + 2]
            own = np.maximum(above, np.maximum(dq - high, low - dq))
            child = tree["children"][node, side]
            if child < 0:
                out[:, -child - 1] = own
            else:
                bound[child] = own
    return out


def search(tree: dict, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float) -> tuple[list[tuple[int, int, float]], float]:
    """(query id, id, score) of each query's k nearest in the tree, and the share of leaf visits that were made."""
    q, x = scaled(queries), tree["scaled"]
    lift = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
    base = (q * q).sum(axis=1) + float((x[0] * x[0]).sum() + tree["extra"][0] ** 2)  # squared distance = base - 2 * inner product
    bounds = leaf_bounds(tree, lift)
    keep = k + 1 + SPARE
    best = np.full((len(q), keep), -np.inf)
    where = np.full((len(q), keep), -1)
    seen = np.zeros(bounds.shape, bool)

    def visit(leaf: int, who: np.ndarray) -> None:
        a, b = tree["leaves"][leaf]
        seen[who, leaf] = True
        got = q[who] @ x[a:b].T
        better = got.max(axis=1) > best[who].min(axis=1)
        who, got = who[better], np.concatenate([best[who[better]], got[better]], axis=1)
        at = np.concatenate([where[who], np.broadcast_to(np.arange(a, b), (len(who), b - a))], axis=1)
        top = np.argpartition(-got, keep - 1, axis=1)[:, :keep]
        best[who], where[who] = np.take_along_axis(got, top, 1), np.take_along_axis(at, top, 1)

    def reaching(who: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """The vectors of all leaves that the bound doesn't exclude whose product reaches `least`."""
        allowed = bounds[who] * factor <= (np.sqrt(np.maximum(0, base[who] - 2 * least[who])) * (1 + 1e-9) + 1e-9)[:, None]
        seen[who] |= allowed
        open_ = np.flatnonzero(allowed.any(axis=0))
        rows = np.concatenate([np.arange(*tree["leaves"][leaf]) for leaf in open_])
        fits = (q[who] @ x[rows].T >= least[who][:, None]) & np.repeat(allowed[:, open_], np.diff(tree["leaves"][open_], axis=1).ravel(), axis=1)
        return [(int(i), rows[f]) for i, f in zip(who, fits)]

    def score(at: np.ndarray, i: int) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return np.cumsum(tree["vectors"][at] * queries[i], axis=1)[:, -1]  # added in order, as SQL engines do

    n = len(tree["leaves"])
    first = np.argsort(bounds, axis=1, kind="stable")[:, : min(n, 4)]
    for leaf in range(n):
        if len(who := np.flatnonzero((first == leaf).any(axis=1))):
            visit(leaf, who)
    for leaf in np.argsort(bounds.mean(axis=0)):
        kth = np.partition(best, keep - 1 - k, axis=1)[:, keep - 1 - k]
        limit = np.sqrt(np.maximum(0, base - 2 * kth)) * (1 + 1e-9) + 1e-9
        if len(who := np.flatnonzero(~seen[:, leaf] & (bounds[:, leaf] * factor <= limit))):
            visit(int(leaf), who)
    kth, slack = np.partition(best, keep - 1 - k, axis=1)[:, keep - 1 - k], 1e-12 * base
    least = kth - slack  # products are rounded otherwise than the scores
    tied = np.isfinite(kth) & (best.min(axis=1) >= least)
    wide = {i: at for some in np.array_split(np.flatnonzero(tied), math.ceil(tied.sum() / TIED) or 1) for i, at in reaching(some)} if tied.any() else {}
    out = []
    for i, own in enumerate(query_ids):
        if i in wide:
            at = wide[i]
            scores = score(at, i)
            n_ids = tree["id_ends"][at + 1] - tree["id_ends"][at]
            flat = np.repeat(tree["id_ends"][at] - np.cumsum(n_ids) + n_ids, n_ids) + np.arange(n_ids.sum())
            others, scores = tree["ids"][flat], np.repeat(scores, n_ids)
            others, scores = others[others != own], scores[others != own]
            out += [(int(own), int(others[j]), float(scores[j])) for j in np.lexsort((others, -scores))[:k]]
            continue
        at = where[i][where[i] >= 0]
        scores = score(at, i)
        found = [(-s, int(v), s) for p, s in zip(at, scores) for v in tree["ids"][tree["id_ends"][p] : tree["id_ends"][p + 1]] if v != own]
        found.sort()
        out += [(int(own), v, float(s)) for _, v, s in found[:k]]
    return out, float(seen.mean())


def searched(batches: Iterator[pa.RecordBatch], k: int, factor: float, block_rows: int) -> Iterator[pa.RecordBatch]:
    """batches: dim, shard, is_query, vec_id, embedding, sorted by the first three. Each shard's neighbours of each query."""

    def runs() -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
        """Rows of equal (dim, shard, is_query) of each batch: ids and vectors."""
        for batch in batches:
            dim, shard, asked = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            ids, lists = batch.column(3).to_numpy(), batch.column(4)
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(dim) != 0) | (np.diff(shard) != 0) | (asked[1:] != asked[:-1])])) if len(dim) else []
            for a, b in zip(starts, [*starts[1:], len(dim)]):
                yield (int(dim[a]), int(shard[a]), bool(asked[a])), ids[a:b], pc.list_flatten(lists.slice(a, b - a)).to_numpy().reshape(b - a, dim[a])

    def found(tree: dict, ids: list[np.ndarray], vectors: list[np.ndarray]) -> pa.RecordBatch:
        out, _ = search(tree, np.concatenate(vectors), np.concatenate(ids), k, factor)
        columns = list(zip(*out)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    tree, of = None, None
    for (dim, shard, asked), own in itertools.groupby(runs(), key=lambda x: x[0]):
        if not asked:
            ids, vectors = zip(*(x[1:] for x in own))
            tree, of = build(np.concatenate(vectors), np.concatenate(ids), k + 1), (dim, shard)
            continue
        if of != (dim, shard):  # no vector of the shard has this length
            continue
        ids, vectors = [], []
        for _, i, v in own:
            for a in range(0, len(i), block_rows):
                ids.append(i[a : a + block_rows])
                vectors.append(v[a : a + block_rows])
                if sum(map(len, ids)) >= block_rows:
                    yield found(tree, ids, vectors)
                    ids, vectors = [], []
        if ids:
            yield found(tree, ids, vectors)


def nearest(
    vectors: DataFrame, is_query: F.Column, k: int = 20, factor: float = 1.0, least_bytes: int = 8 << 20, most_bytes: int = 64 << 20, block_rows: int = 4096,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """A row per query and neighbour: query_id, rank, vec_id, score. is_query: a condition on the column vec_id.

    Shards have at most most_bytes, and as far as that gives no more than two for each core, at most least_bytes. The work
    is that of all queries against all shards; the trees prune within it.
    """
    spark, v = vectors.sparkSession, F.col(vector_col)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"))
    size = rows.agg(F.coalesce(F.sum(F.size("embedding").cast("long")), F.lit(0)).alias("n")).first().n * 8
    shards = max(1, math.ceil(size / most_bytes), min(math.ceil(size / least_bytes), 2 * spark.sparkContext.defaultParallelism))
    # Which shard a vector is in doesn't show in exact results, so rows that repeat an id are spread by their place.
    held = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")).withColumn("is_query", F.lit(False))
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("is_query", F.lit(True))
    both = held.unionByName(asked).select(F.size("embedding").alias("dim"), "shard", "is_query", "vec_id", "embedding")
    streams = both.repartition(max(shards, 2), "dim", "shard").sortWithinPartitions("dim", "shard", "is_query")
    found = streams.mapInArrow(lambda batches: searched(batches, k, factor, block_rows), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
