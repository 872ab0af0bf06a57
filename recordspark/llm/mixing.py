"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Each source gets a target (in words) by water-filling: weights share the budget, no target exceeds `max_repeats` times
its source, the excess is shared again. Within a source a document of weight w is expected min(max_repeats, rate * w)
times, with the one rate at which the expected words are the target. The whole part of that are certain copies; the rest
is the document's inclusion probability p, and the documents with 0 < p < 1 are drawn without replacement by Pareto order
sampling: with random odds u/(1-u), u from a hash of id and size, and inclusion odds p/(1-p), they are taken in the order
of (random odds / inclusion odds) until the fixed size, the words that the certain copies leave of the target, is met.

The weight is that of the document's length class, the number of binary digits of its words (a document of 1,000 words
weighs 10, one of 30 weighs 5), or, with `propensity`, a column: rounded to steps of an eighth of a doubling within
2**-16 to 2**16, null as 1. So a source has some hundred different weights at most, and its rate is exact.

At scale: rows are counted as items of equal (id, source, size), which combine before they shuffle and are stored, so texts
are read once and a repeated or null id is no hot key; copies of an item are numbered, each with a random number of its
own. The order is never sorted as a whole: ranks are cut into `BINS` bins a doubling, sums by (source, bin) give each bin's
start, and only rows of one (source, bin) meet in a window; a source with a third of all rows spreads over thousands of
bins whatever its target. Only (id, source, size) are shuffled, never texts. The table of sources is the only thing ordered
in one place.

Defined results: null text has size 0; a null source is a source of its own, after all others; repeated rows count
each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, unit_interval

WORD = r"[^\x20\x09-\x0D]+"
BINS = 256  # to a doubling of the rank
NUMBERS = 10_000  # copies of an item that one row stands for until they are numbered
EPSILON = 1e-9


def source_targets(sizes: DataFrame, weights=(3.0, 1.0, 2.0), budget: float = 1.5, max_repeats: float = 2.0) -> DataFrame:
    """(source, source_size) -> with target. Sources in code-point order, null last, take the weights in turn.

    Fixed point of "stop at the cap, share the excess": in the order of cap / weight the sources that reach their cap
    come first, so running sums tell for each how much the others share if all before it stand at their caps.
    """
    everywhere = Window.partitionBy(F.lit(0))
    by_name = everywhere.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("turn") - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("turn", F.row_number().over(by_name)).withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    by_fill = everywhere.orderBy(F.col("cap") / F.col("weight"), F.col("turn")).rowsBetween(Window.unboundedPreceding, -1)
    t = (
        t.withColumn("all_size", F.sum("source_size").over(everywhere) * F.lit(float(budget)))
        .withColumn("weight_left", F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(by_fill), F.lit(0.0)))
        .withColumn("size_left", F.col("all_size") - F.coalesce(F.sum("cap").over(by_fill), F.lit(0.0)))
        .withColumn("full", F.col("size_left") * F.col("weight") >= F.col("cap") * F.col("weight_left"))
    )
    # The first source that doesn't reach its cap fixes the share of all later ones.
    first = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "turn", "size_left", "weight_left"))).over(everywhere)
    t = t.withColumn("level", first)
    target = F.when(F.col("full") | F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("level.size_left") * F.col("weight") / F.col("level.weight_left"), F.col("cap")))
    return t.select("source", "source_size", target.alias("target"))


def rates(classes: DataFrame, targets: DataFrame, max_repeats: float) -> DataFrame:
    """classes: (source, w, words). For each: source, w, source_size, target, expected copies, certain ones, p, and the words `rest` that are drawn in the source.

    The heaviest classes reach max_repeats first, so running sums tell what the others share, as in source_targets.
    """
    by_source = Window.partitionBy("source")
    by_weight = by_source.orderBy(F.desc("w"))
    before, from_here = by_weight.rowsBetween(Window.unboundedPreceding, -1), by_weight.rowsBetween(0, Window.unboundedFollowing)
    most = F.lit(float(max_repeats))
    t = classes.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "w", "words", "source_size", "target")
    t = (
        t.withColumn("words_left", F.col("target") - most * F.coalesce(F.sum("words").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum(F.col("words") * F.col("w")).over(from_here))
        .withColumn("full", (F.col("weight_left") <= 0) | (F.col("words_left") * F.col("w") >= most * F.col("weight_left") * F.lit(1 - EPSILON)))
    )
    # The first class that doesn't reach max_repeats fixes the rate of all lighter ones.
    rate = F.max_by(F.when(~F.col("full"), F.col("words_left") / F.col("weight_left")), F.when(~F.col("full"), F.col("w"))).over(by_source)
    t = t.withColumn("expected", F.when(F.col("full"), most).otherwise(F.least(most, rate * F.col("w")))).withColumn("certain", F.floor(F.col("expected") + EPSILON).cast("long"))
    t = t.withColumn("p", F.when(F.col("expected") - F.col("certain") > EPSILON, F.col("expected") - F.col("certain")).otherwise(F.lit(0.0)))
    return t.withColumn("rest", F.col("target") - F.sum(F.col("certain") * F.col("words")).over(by_source)).select("source", "w", "source_size", "target", "expected", "certain", "p", "rest")


def weight_of(propensity: F.Column | None, size: F.Column) -> F.Column:
    if propensity is None:
        return F.length(F.bin(size)).cast("double")
    steps = F.round(F.log2(F.coalesce(propensity.cast("double"), F.lit(1.0))) * 8)
    return F.pow(F.lit(2.0), F.least(F.greatest(F.coalesce(steps, F.lit(-128.0)), F.lit(-128.0)), F.lit(128.0)) / 8)


def size_of(text_col: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, propensity: str | None) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), *([F.col(propensity).alias("own")] if propensity else []))
    return rows.select("doc_id", "source", "size", weight_of(F.col("own") if propensity else None, F.col("size")).alias("w"))


def mix(
    docs: DataFrame, weights=(3.0, 1.0, 2.0), budget: float = 1.5, max_repeats: float = 2.0, seed: int = 7, bins: int = BINS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", propensity: str | None = None,
) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, expected, copies, taken (= copies * size)."""
    items = sized(docs, id_col, text_col, source_col, propensity).groupBy("doc_id", "source", "size", "w").agg(F.count("*").alias("n"))
    items = stored(items, "mix-items")
    classes = items.groupBy("source", "w").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, max_repeats)
    by_class = stored(rates(classes, targets, max_repeats), "mix-rates")

    # Number the rows of each item: those of an item with many rows in parts that are dealt out first.
    parts = items.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {NUMBERS}"))))
    number = F.explode(F.sequence(F.col("part") * NUMBERS + 1, F.least(F.col("n"), (F.col("part") + 1) * NUMBERS)))
    u = unit_interval(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string"), F.col("number").cast("string"))
    # A random number of 0 counts as half a step, so that odds have a logarithm.
    rows = parts.withColumn("number", number).withColumn("u", F.greatest(u, F.lit(2.0**-53))).drop("part", "n")
    rows = rows.alias("r").join(by_class.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.w") == F.col("c.w")))
    rows = rows.select("doc_id", "r.source", "size", "number", "source_size", "target", "expected", "certain", "rest", "p", F.when(F.col("p") > 0, F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p")))).alias("rank"))
    rows = rows.withColumn("bin", F.floor(F.log2("rank") * bins).cast("int"))

    sums = rows.where("p > 0").groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    up_to = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before_bin", F.coalesce(F.sum("bin_size").over(up_to), F.lit(0))).drop("bin_size")
    in_bin = Window.partitionBy("source", "bin").orderBy("rank", "doc_id", "size", "number").rowsBetween(Window.unboundedPreceding, -1)
    drawn = rows.where("p > 0").withColumn("before_row", F.coalesce(F.sum("size").over(in_bin), F.lit(0)))
    drawn = drawn.alias("r").join(sums.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bin") == F.col("b.bin"))).select("r.*", "before_bin")
    # A document goes in while that brings the sum nearer to the rest of the target.
    extra = F.when(F.col("before_bin") + F.col("before_row") + F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)
    out = ("doc_id", "source", "size", "source_size", "target", "expected")
    both = drawn.select(*out, (F.col("certain") + extra).cast("long").alias("copies")).unionByName(rows.where("p = 0").select(*out, F.col("certain").alias("copies")))
    return both.withColumn("taken", F.col("copies") * F.col("size"))
