"""Near duplicates by Order MinHash over word shingles, candidates verified by banded alignment.

A shingle is five words in a row (a shorter text is one shingle), labelled with how often it has occurred before, so that
a text's labelled shingles differ from each other. A sketch is the `pick` labelled shingles that are least under one hash
function, in the order in which they stand in the text; texts that share shingles in another order seldom agree. A band
joins `rows_per_band` sketches; texts that agree in a band are candidates.

The similarity of two texts is that of an alignment of their labelled shingles: with m matched in order, m / (a + b - m)
for texts of a and b shingles, the Jaccard similarity of shingles as far as their order agrees. For a similarity of at
least s, no matched pair can stand further from the diagonal than (a + b)(1 - s)/(1 + s), so only that band is aligned.
As labelled shingles are unique, the alignment is a longest increasing run over the shared positions in the band.

At scale: texts are sketched in one pass without a shuffle; equal texts collapse to one representative by digest. A band
key's members are compared with the least of them (a star, not all pairs); linked components are then found, and every
pair of a band key that is still in two components is compared: as rows up to `exact_group` texts, above it in blocks of
`BLOCK` texts against blocks, where a count of shared shingles leaves only the pairs that can be similar to align.
Links are made stars within partitions; what is left of them goes to one task if it is at most ONE_TASK links, else through
rounds over all tasks. Each stage is a table in the shared folder; nothing about documents or links reaches the driver. Groups of thousands of
copies cost one comparison per distinct text. Hot keys are aggregated before they shuffle and joined under the
adaptive split.

A large key of unlike texts costs all its pairs, block by block.

What may be missed: similar texts that agree in no band (with the defaults about 1 in 1000 at a similarity from 0.8 to 0.85,
fewer above).

Defined results: null text and text without a word are never linked, each is its own class; repeated rows are copies and
so in one class; an id with two texts can be in two classes; rows without an id but with a text are in classes too, whose
class_id is null if none of their rows has an id; ties go to the smaller id; an empty table gives an empty result; further columns are ignored. Texts are
used whole; ids are of any type that has an order.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, slices, stored

WIDTH, SIMILARITY = 5, 0.8
SKETCHES, PICK, BANDS, ROWS_PER_BAND = 64, 2, 56, 4
BLOCK, COLUMNS, SALTS = 128, 8192, 16
MOST_ROUNDS = 100
#: So many links at most are joined to components in one task (16 MB); more take rounds over all tasks.
ONE_TASK = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Hashes of the labelled shingles in the order of the text; none if there is no word."""
    words = text.split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - width + 1)
    out = np.full(n, len(w) if len(w) < width else width, np.uint64)
    for i in range(min(width, len(w))):
        out = mixed(out + w[i : i + n])
    ranked = np.sort(out)
    again = ranked[1:] == ranked[:-1]
    if again.any():  # label what has occurred before with its count
        order = np.argsort(out, kind="stable")
        start = np.maximum.accumulate(np.where(np.concatenate([[True], ~again]), np.arange(n), 0))
        label = np.empty(n, np.uint64)
        label[order] = (np.arange(n) - start).astype(np.uint64)
        out = np.where(label > 0, mixed(out + label * MIX), out)
    return out


@functools.lru_cache(maxsize=8)
def functions(sketches: int, bands: int, rows_per_band: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers of the hash functions, and which sketches each band joins."""
    rng = np.random.default_rng(20)
    factors = rng.integers(0, 1 << 63, sketches, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    chosen = np.array([rng.permutation(sketches)[:rows_per_band] for _ in range(bands)])
    return factors, chosen


def band_keys(hashes: np.ndarray, sketches: int = SKETCHES, pick: int = PICK, bands: int = BANDS, rows_per_band: int = ROWS_PER_BAND) -> np.ndarray:
    factors, chosen = functions(sketches, bands, rows_per_band)
    sketch = np.empty(sketches, np.uint64)
    step = max(1, (1 << 20) // len(hashes))  # long texts take fewer functions at once
    for a in range(0, sketches, step):
        v = (hashes[None, :] * factors[a : a + step, None]) >> np.uint64(20)
        rows, at = np.arange(len(v)), []
        for _ in range(min(pick, len(hashes))):
            least = v.argmin(axis=1)
            at.append(least)
            v[rows, least] = np.uint64(1 << 63)
        at = np.sort(np.stack(at), axis=0)
        out = np.zeros(len(v), np.uint64)
        for positions in at:
            out = mixed(out * np.uint64(3) + hashes[positions])
        sketch[a : a + step] = out
    key = np.arange(1, bands + 1, dtype=np.uint64) * MIX
    for column in chosen.T:
        key = mixed(key + sketch[column])
    return key.view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """The similarity of two texts' labelled shingles, within the band in which it can reach `similarity`."""
    if not len(a) or not len(b):
        return 0.0
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(at_a - at_b) <= (len(a) + len(b)) * (1 - similarity) / (1 + similarity)
    at_a, at_b = at_a[near], at_b[near]
    run = at_b[np.argsort(at_a)]
    if len(run) > 1 and (np.diff(run) < 0).any():
        tails: list[int] = []
        for x in run.tolist():
            i = bisect_left(tails, x)
            tails[i : i + 1] = [x]
        m = len(tails)
    else:
        m = len(run)
    return m / (len(a) + len(b) - m)


def sketched(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, sig (digest of the text), n (shingles), bands array<long>; rows without a word are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, counts, keys = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                if len(hashes := shingles(text, width) if text else ()):
                    at.append(i)
                    counts.append(len(hashes))
                    keys.append(band_keys(hashes))
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * BANDS, pa.int32()), pa.array(flat))
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(counts, pa.int64()), bands], ["doc_id", "sig", "n", "bands"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, sig binary, n long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, width: int = WIDTH) -> DataFrame:
    """Of the pairs (a, b), those at least so similar. texts: rep, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hashes = None, None
        for batch in slices(batches):
            good = []
            for i, (a, s, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if a != last:
                    last, hashes = a, shingles(s, width)
                if aligned(hashes, shingles(t, width), similarity) >= similarity:
                    good.append(i)
            index = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index)], ["a", "b"])

    found = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    return found.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) as stars: each id that isn't the least of its component, and that least id."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            break
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    linked = root != np.arange(len(ids))
    return ids[linked], ids[root[linked]]


def contracted(links: DataFrame) -> DataFrame:
    """links: (a, b). Fewer links (a, b) with the same components: each partition's as stars, of ONE_TASK links or more at a time."""
    most = ONE_TASK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more, count = (np.empty(0, np.int64), np.empty(0, np.int64)), [], 0
        for batch in batches:
            more.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            count += batch.num_rows
            if count > max(most, len(held[0])):
                held, more, count = stars(*map(np.concatenate, zip(held, *more))), [], 0
                if len(held[0]) > most:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, held)], ["a", "b"])
                    held = held[0][:0], held[1][:0]
        held = stars(*map(np.concatenate, zip(held, *more)))
        yield pa.RecordBatch.from_arrays([*map(pa.array, held)], ["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """links: (a, b). The least id of each linked id's component: (rep, root).

    Each partition's links are made stars first; if ONE_TASK links or fewer are left, one task joins them. Otherwise each
    round links every id to the least id in its neighbourhood (and the neighbours to it), until the links are stars
    on roots; the number of rounds grows with the logarithm of the longest chain (more than MOST_ROUNDS are an error). A
    checkpoint ends each round.
    """
    links = stored(contracted(links), "contracted-links")
    if links.count() <= ONE_TASK:
        return stored(contracted(links.coalesce(1)).select(F.col("a").alias("rep"), F.col("b").alias("root")), "components")
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(1), "u"))).first())  # noqa: E731  equal only for equal edges
    before = mark(edges)
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # larger neighbours go to the least one
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # smaller neighbours and the id itself go to the least one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = checkpointed(small)
        if (now := mark(new)) == before:
            return new.select(F.col("u").alias("rep"), F.col("v").alias("root"))
        edges, before = new, now
    raise RuntimeError(f"components aren't stars after {MOST_ROUNDS} rounds")


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots, as components() gives them, with further links (a, b): only the components that these join are worked on, unless
    one task can hold all."""
    if roots.count() + links.count() <= ONE_TASK:
        return components(roots.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(links.select("a", "b")))
    root_of = lambda c: roots.select(F.col("rep").alias(c), F.col("root").alias(f"root_{c}"))
    between = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    moved = components(between.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    old = roots.join(moved.select(F.col("rep").alias("root"), F.col("root").alias("new")), "root", "left").select("rep", F.coalesce("new", "root").alias("root"))
    return checkpointed(old.unionByName(moved))  # what moved was a root, or alone, before


def shared_counts(flat: np.ndarray, lengths: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each text of left shares with each of right. flat: the texts' shingles, one text after another."""
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    row, common = np.repeat(np.arange(len(lengths)), lengths), times > 1
    at = common[column]
    column, row = (np.cumsum(common) - 1)[column[at]], row[at]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(common.sum()), COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        holds = np.zeros((len(lengths), COLUMNS), np.float32)
        holds[row[a:b], column[a:b] - start] = 1
        out += holds[left] @ holds[right].T
    return out


def linked_across(rep: np.ndarray, root: np.ndarray, hashes: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links (a, b) that connect all pairs of left and right at least so similar; pairs already connected need no link."""
    lengths = np.array([len(h) for h in hashes])
    shared = shared_counts(np.concatenate(hashes), lengths, left, right)
    least = (lengths[left][:, None] + lengths[right][None]) * similarity / (1 + similarity) - 1e-6  # what an alignment must match
    i, j = np.nonzero((shared >= least) & (root[left][:, None] != root[right][None]))
    order = np.argsort(-shared[i, j], kind="stable")
    above: dict[int, int] = {}

    def find(x: int) -> int:
        while x in above:
            if (up := above[x]) in above:
                above[x] = above[up]
            x = up
        return x

    out = []
    for a, b in zip(left[i[order]].tolist(), right[j[order]].tolist()):
        x, y = find(int(root[a])), find(int(root[b]))
        if x != y and aligned(hashes[a], hashes[b], similarity) >= similarity:
            above[max(x, y)] = min(x, y)
            out.append((int(rep[a]), int(rep[b])))
    return out


def shingled(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """texts: rep, text. rep, hashes (the labelled shingles in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [shingles(t, width).view(np.int64) for t in batch.column(1).to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, own)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(own) if own else np.empty(0, np.int64)))], ["rep", "hashes"])

    return texts.select("rep", "text").mapInArrow(run, "rep long, hashes array<long>")


def several_roots(members: DataFrame) -> DataFrame:
    """members: key, rep, root. Of the keys that hold several roots: key, size, major (its most frequent root) and major_size."""
    counts = members.groupBy("key", "root").agg(F.count("*").alias("c"))
    keys = counts.groupBy("key").agg(F.sum("c").alias("size"), F.max(F.struct("c", "root")).alias("m"))
    return keys.where(F.col("size") > F.col("m.c")).select("key", "size", F.col("m.root").alias("major"), F.col("m.c").alias("major_size"))


def links_in_blocks(members: DataFrame, keys: DataFrame, texts: DataFrame, similarity: float, width: int = WIDTH, hashes: DataFrame | None = None) -> DataFrame:
    """Links between the roots of each key, from all its pairs of different roots. members: key, rep, root; keys: of several_roots;
    hashes: of shingled() for all members, if they are at hand.

    Members are dealt to blocks by a hash, those of the most frequent root to blocks of their own, which needn't meet each
    other. A pair of blocks is one bounded unit of work.
    """
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK)))
    minor, major = blocks(F.col("size") - F.col("major_size")), blocks(F.col("major_size"))
    is_major, deal = F.col("root") == F.col("major"), F.xxhash64("rep")
    dealt = members.join(keys, "key").select(
        "key", "rep", "root", F.when(is_major, minor + F.pmod(deal, major)).otherwise(F.pmod(deal, minor)).alias("block"),
        F.when(is_major, minor - 1).otherwise(minor + major - 1).alias("last"),
    )
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).select("key", "rep", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    if hashes is None:
        hashes = stored(shingled(texts.join(dealt.select("rep").distinct(), "rep", "left_semi"), width), "block-shingles")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rep").combine_chunks()
        rep, root, block, lists = rows["rep"].to_numpy(), rows["root"].to_numpy(), rows["block"].to_numpy(), rows["hashes"].combine_chunks()
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        own = np.split(pc.list_flatten(lists).to_numpy().view(np.uint64), np.cumsum(pc.list_value_length(lists).to_numpy())[:-1])
        found = linked_across(rep, root, own, left, right, similarity) if len(left) and len(right) else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return met.join(hashes, "rep").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, exact_group: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, class_id (the least id of its class)."""
    return classed(docs, similarity, exact_group, id_col, text_col).select("doc_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def digest(text_col: str = "text") -> F.Column:
    return F.unhex(F.md5(F.col(text_col).cast("string").cast("binary")))


#: A character that isn't white space: what a word has.
WORD = r"[^\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def classed(docs: DataFrame, similarity: float = SIMILARITY, exact_group: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, sig (the text's digest), root (a number for its class; null without a word), class_id (the class's least id)."""
    classes = text_classes(docs, similarity, exact_group, id_col, text_col).withColumn("salt", F.pmod(F.xxhash64("sig"), F.lit(SALTS)).cast("int"))
    # Classes of several texts look up their least id; salted, as one may hold a large share of all texts.
    least = classes.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("c")).where("c > 1").select("root", "class_id", F.lit(True).alias("many"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    classes = classes.join(least, ["root", "salt"], "left").select("sig", "root", F.when(F.col("many"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"))
    return docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("sig")).join(classes, "sig", "left").select("doc_id", "sig", "root", "class_id")


def text_classes(docs: DataFrame, similarity: float = SIMILARITY, exact_group: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per distinct text that has a word: sig (its digest), id (the least that has it), root (a number for its class)."""
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = ids.select("doc_id", digest().alias("sig"), "text")
    base = stored(sketched(rows), "sketches")
    found = base.groupBy("sig").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # Each distinct text gets a number of its own, in the order of its least id.
    reps = stored(found.orderBy(F.col("id").asc_nulls_last(), "sig").withColumn("rep", F.monotonically_increasing_id()), "sketch-reps")
    keyed = reps.select("rep", "n", F.explode("bands").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("rep").alias("a"), F.min_by("n", "rep").alias("n_a"), F.count("*").alias("size")).where("size > 1")
    alike = lambda a, b: F.least(a, b) >= F.greatest(a, b) * F.lit(similarity - 1e-9)  # noqa: E731  what texts of these lengths can reach

    held = stored(keyed.join(heads, "key").select("key", "size", "rep", "n", "a", "n_a"), "band-members")
    star = stored(held.where((F.col("rep") != F.col("a")) & alike(F.col("n"), F.col("n_a"))).select("a", F.col("rep").alias("b")).distinct(), "star-pairs")
    # As a struct an id may be null and equal; the join has dealt the rows as dropDuplicates() needs them.
    wanted = reps.join(held.select("rep").distinct(), "rep", "left_semi").select("rep", "sig", F.struct(F.col("id").alias("doc_id")).alias("own"))
    texts = rows.select("sig", F.struct("doc_id").alias("own"), "text").join(wanted, ["sig", "own"])
    texts = stored(texts.dropDuplicates(["sig", "own"]).select("rep", "text"), "candidate-texts")
    roots = components(stored(verified(star, texts, similarity), "star-links"))

    # Band keys whose members are in several components: pairs across those. Large keys first, in two rounds: what the
    # largest key of each text links leaves the fewer of its other keys in several components.
    place = lambda members: members.join(roots, "rep", "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("root"))
    large = stored(place(held.where(F.col("size") > exact_group)), "large-members")
    keys = stored(several_roots(large), "large-keys")
    if not keys.isEmpty():
        large = stored(large.join(keys.select("key", "size"), "key"), "mixed-large-members")
        # Each text of these keys has one that is its largest, so the first round meets all texts of the second.
        best = large.groupBy("rep").agg(F.max(F.struct("size", "key")).alias("best")).select(F.col("best.key").alias("key")).distinct()
        first = stored(keys.join(best, "key", "left_semi"), "first-keys")
        hashes = stored(shingled(texts.join(large.select("rep").distinct(), "rep", "left_semi")), "block-shingles")
        found = stored(links_in_blocks(large.drop("size"), first, texts, similarity, hashes=hashes), "block-links")
        if not found.isEmpty():
            roots = extended(roots, found)
        large = stored(place(large.drop("root").join(first.select("key"), "key", "left_anti")), "large-members-left")
        keys = stored(several_roots(large), "large-keys-left")
        if not keys.isEmpty():
            found = stored(links_in_blocks(large, keys, texts, similarity, hashes=hashes), "block-links")
            if not found.isEmpty():
                roots = extended(roots, found)

    # Of a small key the pairs at once, as its texts fit in an array.
    own = F.collect_list(F.struct("rep", "n", "root")).alias("own")
    placed = place(held.where(F.col("size") <= exact_group)).groupBy("key").agg(own, F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    meet = lambda x, y: (x["rep"] < y["rep"]) & (x["root"] != y["root"]) & alike(x["n"], y["n"])
    pairs = F.flatten(F.transform("own", lambda x: F.transform(F.filter("own", lambda y: meet(x, y)), lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b")))))
    across = placed.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()
    across = stored(across.join(star, ["a", "b"], "left_anti"), "cross-pairs")
    more = stored(verified(across, texts, similarity), "cross-links")
    if not more.isEmpty():
        roots = extended(roots, more)
    return reps.join(roots, "rep", "left").select("sig", "id", F.coalesce("root", "rep").alias("root"))
