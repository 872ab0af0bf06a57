"""BPE encoding and decoding with a contiguous array of ranks.

A word is held as its list of parts and, beside it, the rank of the merge of each part with the next. The smallest rank
is found by scanning, that boundary goes, and the two ranks beside it are looked up anew. Words over `SHORT` bytes,
where scanning would take the square of the length, use a heap of the same ranks; the result is the same.

Around that: the special tokens' strings are cut out first; a space before a visible character always begins a new
word, so texts are split at spaces in C and each distinct chunk is encoded once for each Python worker, in a cache of
at most `cache_words` entries (a full cache is emptied). Nothing is shuffled: rows stream through Arrow batches.

Defined results: null text counts as empty and gives no ids; any text is whole, however long; repeated rows give
repeated results; an empty table gives an empty result; further columns are ignored. The tokenizer's file must exist
at `path` on every executor.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

SHORT = 256
NONE = 1 << 60
#: The byte-level pattern of words, with the Unicode white space spelled out.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a visible character: its own where it has one, else the next from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class NotPlain(Exception):
    """A chunk that doesn't begin with a visible character: the text isn't split at spaces."""


class Words(dict):
    """Chunk -> its ids as little-endian bytes, made when first asked for."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, chunk: str) -> bytes:
        made, keep = self.make(chunk)
        if keep:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = made
        return made


class Bpe:
    def __init__(self, path: str, cache_words: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        #: left id * size + right id -> rank, and rank -> merged id
        self.size, self.rank, self.merged = size, {}, []
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] * size + vocab[b]] = n
            self.merged.append(vocab[a + b])
        self.words = regex.compile(PATTERN).findall
        self.pieces = Words(lambda piece: (self.pack(self.merge(piece.encode())), len(piece) < 64), cache_words)
        self.after_space = Words(self.spaced, cache_words)

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        packed = array("I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        parts = [self.byte_id[b] for b in word]
        if len(parts) > SHORT:
            return self.merge_long(parts)
        rank, size, merged = self.rank.get, self.size, self.merged
        ranks = [rank(a * size + b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NONE:
            i = ranks.index(least)
            parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] * size + parts[i + 1], NONE)
            if i:
                ranks[i - 1] = rank(parts[i - 1] * size + parts[i], NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        rank, size, n = self.rank.get, self.size, len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(parts[i] * size + parts[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if parts[i] >= 0 else n
            if j >= n or rank(parts[i] * size + parts[j], NONE) != r:
                continue  # one of the two has changed since
            parts[i], parts[j] = self.merged[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (q := rank(parts[a] * size + parts[b], NONE)) != NONE:
                    heapq.heappush(heap, (q, a))
        return [p for p in parts if p >= 0]

    def spaced(self, chunk: str) -> tuple[bytes, bool]:
        """The ids of a space and the chunk; what spans lines or is long seldom comes again and isn't kept."""
        if not chunk or chunk[0].isspace():
            raise NotPlain
        found = self.words(" " + chunk)
        return b"".join(map(self.pieces.__getitem__, found)) if len(found) > 1 else self.pack(self.merge(found[0].encode())), len(chunk) < 64 and len(found) < 4 and "\n" not in chunk

    def encode_plain(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            return b"".join(map(self.pieces.__getitem__, self.words(first))) + b"".join(map(self.after_space.__getitem__, rest))
        except NotPlain:
            return b"".join(map(self.pieces.__getitem__, self.words(text)))

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.special_cut is None or not any(s in text for s in self.special):
            return self.encode_plain(text)
        return b"".join(self.pack([self.special[x]]) if x in self.special else self.encode_plain(x) for x in self.special_cut.split(text))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def loaded(path: str, cache_words: int) -> Bpe:
    """One for each Python worker; its cache stays from task to task."""
    return Bpe(path, cache_words)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", cache_words: int = 500_000) -> DataFrame:
    """A row per document: doc_id, ids array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, cache_words)
        for batch in slices(batches):
            packed = [bpe.encode_bytes(t or "") for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in packed)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Of encode()'s rows: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, 1000)
        for batch in slices(batches):
            texts = [None if ids is None else bpe.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", cache_words: int = 500_000) -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = loaded(path, cache_words), lambda x: hashlib.sha256(x).hexdigest()
        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                packed = bpe.encode_bytes(text or "")
                decoded = bpe.decode(np.frombuffer(packed, "<u4").tolist())
                out.append((len(packed) // 4, sha(packed), sha(decoded.encode())))
            n, ids, texts = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
