"""The corpus pipeline: language ID, near-duplicate removal, mixing of sources, BPE.

Each stage takes all that the one before kept and writes it as Parquet, so that a lost executor repeats part of a stage
only. All but the last return the columns of `documents`; further columns of the input are dropped.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordspark.llm import bpe, langid, minhash, mixing
from recordspark.llm.queries import tokenizer_path
from recordspark.llm.shared import MADE, dropped, importable, table
from recordspark.sources.workdir import remove, removed_at_exit, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document in which no language holds this share is rejected, as is one without a letter.
LEAST_SHARE = 0.5
CACHE_WORDS = 100_000


def same(column: str) -> Column:
    """The column as text to join by, in which null is a value."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are mostly in one learned language; lang becomes the language found."""
    importable(spark)
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.keep(docs.select(*COLUMNS), model, LEAST_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates: that of the least id, then of the least digest of its text.

    Rows that repeat are one document; rows with neither an id nor a word all stay.
    """
    importable(spark)
    kept = minhash.text_classes(docs).groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "sig")).alias("row"))
    kept = kept.select(same("row.id").alias("_id"), F.col("row.sig").alias("_sig"))
    rows = docs.select(*COLUMNS).withColumns({"_id": same("doc_id"), "_sig": F.coalesce(minhash.digest(), F.lit(b""))})
    has_word = F.coalesce(F.regexp_like("text", F.lit(minhash.WORD)), F.lit(False))
    # Of rows that repeat the one whose other columns come first.
    first = lambda df: df.withColumn("_turn", F.row_number().over(Window.partitionBy("_id", "_sig").orderBy("lang", "source", "n_chars"))).where("_turn = 1")
    wordless = rows.where(~has_word)
    out = [first(rows.where(has_word).join(kept, ["_id", "_sig"])), first(wordless.where("doc_id is not null")), wordless.where("doc_id is null")]
    return reduce(DataFrame.unionByName, (df.select(*COLUMNS) for df in out))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it.

    The mix says how often rows of equal (id, source, size) are taken; where several share these, the first of them by
    their texts' digests get one more than the others.
    """
    key = [same("doc_id").alias("_id"), same("source").alias("_source"), F.col("size").alias("_size")]
    taken = mixing.mix(docs).groupBy(*key).agg(F.count("*").alias("_rows"), F.min("copies").alias("_each"), F.sum("copies").alias("_all")).where("_all > 0")
    rows = docs.select(*COLUMNS).withColumn("size", mixing.size_of("text")).withColumns(dict(zip(("_id", "_source", "_size"), key)))
    rows = rows.join(taken, ["_id", "_source", "_size"])
    turn = F.row_number().over(Window.partitionBy("_id", "_source", "_size").orderBy(F.when(F.col("_rows") > 1, F.md5(F.col("text").cast("binary"))), "lang", "n_chars"))
    copies = F.col("_each") + F.when(turn <= F.col("_all") - F.col("_rows") * F.col("_each"), 1).otherwise(0)
    rows = rows.withColumn("copies", copies.cast("int")).where("copies > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document that the mix holds: doc_id, n_tokens, ids.

    Workers keep their words' ids from task to task; few of them, as the same workers serve the other stages.
    """
    importable(spark)
    return bpe.encode(docs, tokenizer_path(), cache_words=CACHE_WORDS).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("mix", mix_sources), ("bpe", encode)]
#: SQL has neither the language model nor the sketches nor BPE; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. What a stage stored on its way, and the rows it read, are deleted when it is written;
    the last stage's rows when the driver ends."""
    docs, at, last = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    removed_at_exit(spark, at)
    for name, stage in STAGES:
        made = len(MADE)
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        dropped(spark, made)
        if last:
            remove(spark, last)
        last = f"{at}/{name}"
        docs = spark.read.parquet(last)
    return docs
