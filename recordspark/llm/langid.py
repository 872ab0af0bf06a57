"""Language identification by mixture inference.

Each language is a multinomial over hashed letter trigrams. A document is a mixture: expectation-maximisation finds the
share of each language that makes its trigrams likeliest. The set of languages is chosen by penalised likelihood: the
languages are taken in the order of their shares, and one more is accepted only while it raises the log-likelihood by
more than `penalty` times the logarithm of the number of trigrams. The largest share names the document's language.

Fitting takes, of each labelled language, about `fit_rows` documents, whole: those whose id's hash, in [0, 1), is under
fit_rows / (the language's documents); all of them where there are fewer. Each executor filters and counts what it reads:
only counts by (language, bucket) are shuffled. The driver holds a row for each language and the model, 4 bytes * buckets
* languages; more than `most_languages` values of lang are an error, not a cut. Prediction covers every row in one pass without a shuffle; the model is broadcast.

Defined results: null text, and text without any letter, is `und` with score 0 (as is everything when nothing was
learned); ties go to the language first in code-point order; an empty table gives an empty result; repeated rows give
repeated results; further columns are ignored. Texts are used whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, unit_interval

BUCKET_BITS, FIT_ROWS, UNKNOWN = 16, 1000, "und"
BUCKETS = 1 << BUCKET_BITS


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that occur, and how often; runs of what isn't a letter count as one space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    c = np.where(letters()[c], c, 32)
    c = np.concatenate([[32], c, [32]]).astype(np.uint64)
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    if len(c) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    code = (code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique((code >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), return_counts=True)


@dataclass
class Model:
    languages: list[str]
    chance: np.ndarray  # bucket x language


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, smoothing: float = 0.5, most_languages: int = 1000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), unit_interval(F.lit("fit"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("u")
    )
    labels = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(labels) > most_languages:
        raise ValueError(f"lang has more than {most_languages} values")
    if not labels:
        return Model([], np.empty((BUCKETS, 0), np.float32))
    most = F.create_map(*[F.lit(x) for lang, n in labels.items() for x in (lang, min(1.0, fit_rows / n))])
    sample = rows.where(F.col("u") < most[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                buckets, n = trigrams(text)
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))[buckets] += n
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    got = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(got["lang"].unique())
    chance = np.full((BUCKETS, len(languages)), smoothing)
    for i, lang in enumerate(languages):
        own = got[got["lang"] == lang]
        chance[own["bucket"].to_numpy(), i] += own["n"].to_numpy()
    return Model(languages, (chance / chance.sum(axis=0, keepdims=True)).astype(np.float32))


def shares_of(chance: np.ndarray, n: np.ndarray, start: np.ndarray, rounds: int, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """Expectation-maximisation: the languages' shares and the log-likelihood. chance: the document's buckets x languages."""
    share, total = start, n.sum()
    for _ in range(rounds):
        mixed = chance @ share
        new = share * ((n / mixed) @ chance) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < tolerance:
            break
    return share, float(n @ np.log(chance @ share))


def infer(model: Model, text: str | None, penalty: float = 3.0, rounds: int = 30) -> list[tuple[str, float]]:
    """The chosen languages with their shares, largest first; empty if there is no letter."""
    if not text or not model.languages:
        return []
    at, n = trigrams(text)
    if not len(at):
        return []
    n = n.astype(np.float64)
    chance = model.chance[at].astype(np.float64)
    width = len(model.languages)
    share, _ = shares_of(chance, n, np.full(width, 1 / width), rounds)
    order = np.argsort(-share, kind="stable")
    one = int(order[0])
    chosen, shares, likely = [one], np.ones(1), float(n @ np.log(chance[:, one]))
    price = penalty * np.log(n.sum() + 1)
    for size in range(2, width + 1):
        if share[order[size - 1]] < 0.02:
            break
        own = order[:size]
        new, value = shares_of(chance[:, own], n, share[own] / share[own].sum(), rounds)
        if value - likely <= price:
            break
        chosen, shares, likely = own.tolist(), new, value
    return sorted(((model.languages[i], float(min(1.0, s))) for i, s in zip(chosen, shares)), key=lambda x: (-x[1], x[0]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, lang_pred, score, languages array<struct<lang,share>>."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [infer(shared.value, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([x[0][0] if x else UNKNOWN for x in found], pa.string()), pa.array([x[0][1] if x else 0.0 for x in found], pa.float64()),
                    pa.array([[{"lang": a, "share": b} for a, b in x] for x in found], kind),
                ],
                ["doc_id", "lang_pred", "score", "languages"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def held_out(id_col: str = "doc_id") -> F.Column:
    """A quarter of the documents, told by the checksum of the id as text; never learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def keep(docs: DataFrame, model: Model, least_share: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs in which one language holds at least least_share, with lang as found; in one pass, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [infer(shared.value, t) for t in batch.column(text_at).to_pylist()]
            good = [i for i, x in enumerate(found) if x and x[0][1] >= least_share]
            taken = batch.take(pa.array(good, pa.int64()))
            columns = [pa.array([found[i][0][0] for i in good], pa.string()) if n == lang_at else taken.column(n) for n in range(len(docs_columns))]
            yield pa.RecordBatch.from_arrays(columns, docs_columns)

    docs_columns = list(docs.columns)
    return docs.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes))
