"""WARC archives whose records are Zstandard frames with a dictionary of the archive's own.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds a dictionary built from records of the archive;
each record is then a frame by itself, compressed with it, so that a reader can seek to any record. Of records with
equal payloads the one with the smallest id is a response; the others are revisits, which name it and hold no payload.

At scale: payloads move once, and only one of each: rows are grouped by digest, which combines copies before it shuffles,
into responses, each with its payload, and what else was counted with it. Revisits have no payload; they are rows of (id,
url, digest), counted where equal, and joined to their response's id alone, a join whose hot keys the adaptive split takes
apart. Each task then packs the records that it has into archives as they stream by, of at most `archive_rows` records or
`archive_bytes`, so neither a hot payload nor a row that repeats without end meets in one archive, and Spark sizes the
partitions. Archives are rows of a Parquet table in the shared folder (any store that Spark writes to; commits survive lost
executors); `unpack` writes them as files.

Defined results: null payloads count as empty; a row that comes again (equal id and payload) revisits its own id; null
ids come after all others, so they revisit any equal payload with an id (or one without, whose revisits name none); of
equal ids the response is the one with the least url, null first; an empty table gives an empty archive table; further
columns are ignored. A dictionary is built from samples of an archive's records, of which the first 128 KiB of each
sampled one count; records are always stored whole.
"""

from __future__ import annotations

import base64
import hashlib
import math
import struct
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, stored

#: The format's skippable frame that holds the dictionary, and Zstandard's own marks.
DICTIONARY_FRAME, FRAME, DICTIONARY = 0x184D2A5D, b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 1 << 20, 32 << 10, 3
TIMES = 1000  # equal revisits that one row stands for


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(number: str, url: str | None, payload: bytes, sha: str, kind: str, refers: str | None, length: int | None = None) -> bytes:
    """One WARC/1.1 record; line ends within a url would break its header and are percent-encoded."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:recordspark:{number}>", f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {len(payload) if length is None else length}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:recordspark:{refers}>"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode() + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record's length is wrong")
    return fields, rest[:size]


def dictionary(records: list[bytes]) -> bytes:
    """Built from records up to SAMPLE_BYTES, taken at even steps; empty if they are too few to build one."""
    step = max(1, math.ceil(sum(map(len, records)) / SAMPLE_BYTES))
    sample = [x[:131072] for x in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archive(records: list[bytes]) -> bytes:
    own = dictionary(records)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(own) if own else None, write_checksum=True)
    head = zstandard.ZstdCompressor(level=LEVEL).compress(own) if own else b""
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(head)), head, *map(packer.compress, records)])


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records, one frame after another."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    own, rest = data[8 : 8 + size], memoryview(data)[8 + size :]
    if own[:4] == FRAME:
        own = zstandard.ZstdDecompressor().decompress(own)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own) if own else None)
    while len(rest):
        one = unpacker.decompressobj()
        yield one.decompress(rest)
        rest = rest[len(rest) - len(one.unused_data) :]


def write(pages: DataFrame, least: int = 0, archive_rows: int = 2000, archive_bytes: int = 16 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives: a table of archive long, records long, data binary. Payloads under `least` bytes are never revisits."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= least
    place = F.struct(F.col("id").isNull().alias("none"), "id", "url")
    first = rows.where(large).groupBy("sha").agg(F.min(place).alias("f"), F.first("html").alias("html"))
    responses = first.select("f.id", "f.url", "html").unionByName(rows.where(~large).select("id", "url", "html"))

    # Revisits: all rows but one of each payload. Those of equal id and url are counted, the response taken off its own.
    counted = rows.where(large).groupBy("sha", "id", "url", F.octet_length("html").cast("long").alias("bytes")).agg(F.count("*").alias("n"))
    shared = counted.groupBy("sha").agg(F.min(place).alias("f"), F.sum("n").alias("all")).where(F.col("all") > 1).select("sha", "f")
    again = counted.join(shared, "sha").withColumn("n", F.col("n") - F.when(place.eqNullSafe(F.col("f")), 1).otherwise(0)).where("n > 0")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {TIMES}")))
    again = again.withColumn("part", part).withColumn("times", F.least(F.lit(TIMES).cast("long"), F.col("n") - F.col("part") * TIMES))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    records = responses.select(text("id").alias("number"), "url", "html", F.lit(None).cast("string").alias("sha"), F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("string").alias("refers"), F.lit(1).cast("long").alias("times"))
    revisits = again.select(text("id").alias("number"), "url", F.lit(None).cast("string").alias("html"), "sha", "bytes", text("f.id").alias("refers"), "times")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size, made = [], 0, TaskContext.get().partitionId() << 32

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([write_archive(own)], pa.binary())], ["archive", "records", "data"])

        for batch in slices(batches):
            for number, url, html, sha, bytes_, refers, times in zip(*(c.to_pylist() for c in batch.columns)):
                payload = b"" if html is None else html.encode()
                kind, digest_ = ("response", digest(payload)) if html is not None else ("revisit", base64.b32encode(bytes.fromhex(sha)).decode())
                one = record(number, url, payload, digest_, kind, refers, len(payload) if bytes_ is None else bytes_)
                for _ in range(times):
                    if own and (len(own) >= archive_rows or size + len(one) > archive_bytes):
                        yield archive()
                        own, size, made = [], 0, made + 1
                    own.append(one)
                    size += len(one)
        if own:
            yield archive()

    return stored(records.unionByName(revisits).mapInArrow(pack, "archive long, records long, data binary"), "warc")


def read(archives: DataFrame) -> DataFrame:
    """A row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def number(text: str | None) -> int | None:
        text = text and text.removeprefix("<urn:recordspark:").removesuffix(">")
        return None if text in (None, "null") else int(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for raw in read_archive(data.as_py()):
                    fields, payload = parse(raw)
                    kind = fields["WARC-Type"]
                    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest(payload) != sha:
                        raise ValueError("a payload doesn't have its digest")
                    rows.append((number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), sha, kind, number(fields.get("WARC-Refers-To")), payload if kind == "response" else None))
                columns = list(zip(*rows)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))

    return archives.select("data").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def unpack(archives: DataFrame, folder: str) -> None:
    """Writes each archive as a .warc.zst file; folder must be one that this machine and all executors mount."""

    def run(rows: Iterator[Any]) -> None:
        for row in rows:
            with open(f"{folder}/{row.archive:08d}.warc.zst", "wb") as f:
                f.write(row.data)

    archives.foreachPartition(run)
