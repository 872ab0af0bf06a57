"""Media columns: AVI with motion-JPEG frames, written and read, and shots found by adaptive histogram differences.

Reading: the RIFF index (or, without one, the movie list) gives the frames; each is a baseline JPEG whose luma is
decoded by itself; a frame starts a new shot where its luma histogram differs from the one before by more than the mean
plus `k` standard deviations of the differences around it. A clip row gives a shot's first frame, end, times and mean histogram.

Writing holds any bytes without loss: each 64 bytes are the quantised coefficients of one 8x8 block, the format's unit.
A byte b is the coefficient whose eight amplitude bits are b (b from 128, else b - 255), always of size class 8 after
no zeros. That class's Huffman code is eight 0 bits, so a coefficient takes two whole bytes and the stored column compresses
as the text does; a restart marker after each block sets the DC prediction to zero. The stream is a plain baseline JPEG;
its uniform code lets numpy write and read it a frame at a time, without a loop over symbols. Other baseline frames go
through the general Huffman decoder, which reads its bits in one pass.

Each media value is handled by itself: no shuffle. A value is written and read frame by frame, so that a task holds some
times the longest value. Files over 1 GB in several RIFF segments are read whole. Defined results: null text or media counts
as empty; broken media raises an error that names what is wrong; equal texts give equal values; an empty table gives an
empty result; further columns are ignored. Frames without their own Huffman tables, and progressive ones, are errors.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

SIDE, BINS, FPS = 8, 16, 25  # blocks to a frame's side; histogram bins; frames a second
PER_FRAME = SIDE * SIDE
FEW = 32  # values to a batch of media
#: The zigzag order of an 8x8 block, made from its diagonals.
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))])
_k = np.arange(8)
COSINES = np.sqrt(np.where(_k == 0, 1, 2) / 8)[:, None] * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16)
#: Coefficients in scan order -> samples of the block.
TO_SAMPLES = np.kron(COSINES, COSINES)[ZIGZAG]
RESTARTS = [bytes([0xFF, 0xD0 + i]) for i in range(8)]
BLOCK_BYTES = 2 + 2 * 64  # a restart marker and a block's scan, if no byte of it is 0xFF


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def one_code(kind: int, symbol: int, length: int = 8) -> bytes:
    """A Huffman table with one symbol, whose code is so many 0 bits."""
    return bytes([kind << 4]) + bytes([int(n == length) for n in range(1, 17)]) + bytes([symbol])


FRAME_HEAD = b"".join(
    [
        b"\xff\xd8", segment(0xDB, b"\0" + b"\1" * 64), segment(0xC0, struct.pack(">BHHB3B", 8, SIDE * 8, SIDE * 8, 1, 1, 0x11, 0)),
        segment(0xC4, one_code(0, 8) + one_code(1, 8)), segment(0xDD, struct.pack(">H", 1)), segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ]
)


def padded(data: bytes) -> bytes:
    """With bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 if data else 64)


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_frame(data: bytes) -> bytes:
    """Up to 4,096 bytes as one JPEG, filled up with bytes 0."""
    blocks = np.zeros((PER_FRAME, BLOCK_BYTES), np.uint8)
    own = np.frombuffer(data, np.uint8).reshape(-1, 64)
    blocks[: len(own), 3::2] = own
    blocks[:, 0], blocks[1:, 1] = 0xFF, 0xD0 + np.arange(PER_FRAME - 1) % 8
    if (own == 0xFF).any():  # within a scan a byte 0 follows it
        scan = b"".join(RESTARTS[(i - 1) % 8] * (i > 0) + b[2:].tobytes().replace(b"\xff", b"\xff\0") for i, b in enumerate(blocks))
    else:
        scan = blocks.tobytes()[2:]
    return FRAME_HEAD + scan + b"\xff\xd9"


def write_avi(payload: bytes, n_bytes: int | None = None) -> bytes:
    """payload: a multiple of 64 bytes. Its length, and n_bytes of it that count, stand in a chunk of their own."""
    movie, index, at = [], [], 4
    for start in range(0, len(payload), PER_FRAME * 64):
        movie.append(chunk(b"00dc", write_frame(payload[start : start + PER_FRAME * 64])))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, struct.unpack_from("<I", movie[-1], 4)[0]))
        at += len(movie[-1])
    n, side = len(movie), SIDE * 8
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, 0, side, side, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, 0, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    length = chunk(b"plen", struct.pack("<QQ", len(payload), len(payload) if n_bytes is None else n_bytes))
    return chunk(b"RIFF", b"AVI " + header + length + chunk(b"LIST", b"movi" + b"".join(movie)) + chunk(b"idx1", b"".join(index)))


def chunks_of(media: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and end of the body of each chunk."""
    while at + 8 <= end:
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        yield name, at + 8, min(at + 8 + size, len(media))
        at += 8 + size + size % 2


def layout(media: bytes) -> tuple[list[tuple[int, int]], float, tuple[int, int] | None]:
    """Where the frames are, frames a second, and the lengths that write_avi noted."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, lengths, frames, movies = float(FPS), None, [], 0
    is_frame = lambda name: name[2:] in (b"dc", b"db")
    for riff, start, end in chunks_of(media, 0, len(media)):  # a large file goes on in further segments
        if riff != b"RIFF" or media[start : start + 4] not in (b"AVI ", b"AVIX"):
            continue
        movie, entries = None, []
        for name, a, b in chunks_of(media, start + 4, end):
            kind = media[a : a + 4]
            if name == b"LIST" and kind == b"hdrl":
                i = media.find(b"strh", a, b)
                if i > 0:
                    scale, rate = struct.unpack_from("<II", media, i + 8 + 20)
                    fps = rate / scale if scale and rate else fps
            elif name == b"LIST" and kind == b"movi":
                movie, movies = (a, b), movies + 1
            elif name == b"idx1":
                entries = [(n, o, s) for n, _, o, s in struct.iter_unpack("<4sIII", media[a : a + (b - a) // 16 * 16])]
            elif name == b"plen":
                lengths = struct.unpack_from("<QQ", media, a)
        if movie and entries:
            base = movie[0] if media[movie[0] + entries[0][1] : movie[0] + entries[0][1] + 4] == entries[0][0] else 0  # from the list, or from the file's start
            frames += [(base + offset + 8, base + offset + 8 + size) for name, offset, size in entries if is_frame(name)]
        elif movie:
            for name, a, b in chunks_of(media, movie[0] + 4, movie[1]):
                frames += [(x, y) for n, x, y in chunks_of(media, a + 4, b) if is_frame(n)] if name == b"LIST" else [(a, b)] * is_frame(name)
    if not movies:
        raise ValueError("AVI without a movi list")
    return frames, fps, lengths


def parse_avi(media: bytes) -> tuple[list[bytes], float, tuple[int, int] | None]:
    """Frames, frames a second, and the lengths that write_avi noted."""
    spans, fps, lengths = layout(media)
    return [media[a:b] for a, b in spans], fps, lengths


def payload_of(media: bytes) -> tuple[bytes, int]:
    """What write_avi stored, and how many bytes of it count."""
    spans, _, lengths = layout(media)
    if lengths is None:
        raise ValueError("AVI without a length chunk")
    return b"".join(uniform_blocks(media[a:b]) for a, b in spans)[: lengths[0]], lengths[1]


def uniform_blocks(frame: bytes) -> bytes:
    """The bytes in a frame of write_avi."""
    if not frame.startswith(FRAME_HEAD) or frame[-2:] != b"\xff\xd9":
        raise ValueError("not a frame of the uniform code")
    scan = frame[len(FRAME_HEAD) : -2]
    if len(scan) == PER_FRAME * BLOCK_BYTES - 2:  # no byte 0xFF in it
        coded = np.frombuffer(b"\xff\xd7" + scan, np.uint8).reshape(PER_FRAME, BLOCK_BYTES)
        if (coded[:, 0] != 0xFF).any() or (coded[1:, 1] != 0xD0 + np.arange(PER_FRAME - 1) % 8).any():
            raise ValueError("restart markers aren't where they should be")
        coded = coded[:, 2:]
    else:
        coded = np.frombuffer(re.sub(rb"\xff[\xd0-\xd7]", b"", scan).replace(b"\xff\0", b"\xff"), np.uint8).reshape(PER_FRAME, -1)
    if coded[:, ::2].any():
        raise ValueError("a code that the Huffman table doesn't have")
    return coded[:, 1::2].tobytes()


def amplitude(bits: int, size: int) -> int:
    return bits if size == 0 or bits >> (size - 1) else bits - (1 << size) + 1


def huffman(body: bytes, counts_at: int) -> tuple[dict[tuple[int, int], int], int]:
    """(length, code) -> symbol, and where the table ends."""
    table, code, at = {}, 0, counts_at + 16
    for length in range(1, 17):
        for _ in range(body[counts_at + length - 1]):
            table[length, code] = body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table, at


class Bits:
    """Reads a scan's bits one after another, from the four bytes around the place."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(4), 0, 8 * len(data)

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 4], "big") >> (32 - (self.at & 7) - n) & ((1 << n) - 1)

    def moved(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise ValueError("JPEG scan ends too soon")

    def take(self, n: int) -> int:
        value = self.peek(n)
        self.moved(n)
        return value

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = self.peek(16)
        for length in range(1, 17):
            found = table.get((length, code >> (16 - length)))
            if found is not None:
                self.moved(length)
                return found
        raise ValueError("a code that the Huffman table doesn't have")


def decode_luma(frame: bytes) -> np.ndarray:
    """The first component's samples (rows, columns) of a baseline JPEG."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    tables, quants, parts, interval, at = {}, {}, [], 0, 2
    while True:
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("JPEG segments are broken")
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body, at = frame[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                quants[body[i] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, i + 1).astype(np.int64)
                i += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                kind = body[i]
                tables[kind], i = huffman(body, i + 1)
        elif marker in (0xC0, 0xC1):
            height, width = struct.unpack_from(">HH", body, 1)
            parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only baseline JPEG frames are read")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            break
    for i in range(body[0]):
        part = next(p for p in parts if p["id"] == body[1 + 2 * i])
        part["dc"], part["ac"] = body[2 + 2 * i] >> 4, 0x10 | body[2 + 2 * i] & 15
        if part["dc"] not in tables or part["ac"] not in tables:
            raise ValueError("JPEG frame without its Huffman tables")
    if len(parts) == 1:
        parts[0]["h"] = parts[0]["v"] = 1
    h, v = max(p["h"] for p in parts), max(p["v"] for p in parts)
    wide, high = -(-width // (8 * h)), -(-height // (8 * v))
    end = frame.rfind(b"\xff\xd9")
    runs = [Bits(x.replace(b"\xff\0", b"\xff")) for x in re.split(rb"\xff[\xd0-\xd7]", frame[at : end if end > 0 else None])]
    first = parts[0]
    coefs = np.zeros((high * first["v"], wide * first["h"], 64), np.int64)
    bits, last = runs[0], {}
    for n in range(wide * high):
        if n == 0 or interval and n % interval == 0:
            bits, last = runs[n // interval if interval else 0], {}
        for p in parts:
            for y in range(p["v"]):
                for x in range(p["h"]):
                    block = np.zeros(64, np.int64)
                    size = bits.symbol(tables[p["dc"]])
                    last[p["id"]] = block[0] = last.get(p["id"], 0) + amplitude(bits.take(size), size)
                    k = 1
                    while k < 64:
                        run, size = divmod(bits.symbol(tables[p["ac"]]), 16)
                        if size == 0 and run != 15:
                            break
                        k += run
                        if size:
                            block[k] = amplitude(bits.take(size), size)
                        k += 1
                    if p is first:
                        coefs[n // wide * p["v"] + y, n % wide * p["h"] + x] = block
    rows, columns = coefs.shape[:2]
    samples = samples_of((coefs * quants[first["q"]]).reshape(-1, 64)).reshape(rows, columns, 8, 8)
    return samples.transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)[: -(-height * first["v"] // v), : -(-width * first["h"] // h)]


def samples_of(coefs: np.ndarray) -> np.ndarray:
    """Blocks of coefficients in scan order -> blocks of 64 samples."""
    out = coefs.astype(np.float32) @ TO_SAMPLES.astype(np.float32)
    return np.clip(np.rint(out + 128), 0, 255).astype(np.uint8)


def histogram(luma: np.ndarray) -> np.ndarray:
    """The share of each luma bin."""
    counts = np.bincount((luma >> 4).ravel(), minlength=BINS)
    return counts / counts.sum()


def uniform_luma(data: bytes) -> np.ndarray:
    """The samples, block after block, of a frame that holds these bytes."""
    b = np.frombuffer(data, np.uint8).reshape(-1, 64).astype(np.int16)
    return samples_of(np.where(b < 128, b - 255, b))


def luma_of(frame: bytes) -> np.ndarray:
    return uniform_luma(uniform_blocks(frame)) if frame.startswith(FRAME_HEAD) else decode_luma(frame)


def shots(hist: np.ndarray, k: float = 2.0, reach: int = 12, floor: float = 0.1) -> list[tuple[int, int]]:
    """[first, end) of each shot: cuts where the difference to the frame before stands out among those around it."""
    if len(hist) == 0:
        return []
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    cuts = [0]
    for i, x in enumerate(d):
        near = np.delete(d[max(0, i - reach) : i + reach + 1], min(i, reach))
        if x > floor and x > (near.mean() + k * near.std() if len(near) else 0.5):
            cuts.append(i + 1)
    return list(zip(cuts, [*cuts[1:], len(hist)]))


def write_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, media binary, an AVI that holds the text's UTF-8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, FEW):
            raw = ((t.as_py() or "").encode() for t in part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([write_avi(padded(x), len(x)) for x in raw], pa.binary())], ["doc_id", "media"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, media binary")


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row per shot: doc_id, clip, first_frame, end_frame, start_s, end_s, histogram array<double>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, out = [], []
            for i, data in enumerate(batch.column(1).to_pylist()):
                spans, fps, _ = layout(data) if data else ([], 1.0, None)
                hist = np.array([histogram(luma_of(data[a:b])) for a, b in spans])
                for n, (a, b) in enumerate(shots(hist)):
                    ids.append(i)
                    out.append((n, a, b, a / fps, b / fps, hist[a:b].mean(axis=0).round(6).tolist()))
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "clip", "first_frame", "end_frame", "start_s", "end_s", "histogram"])

    rows = media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, clip int, first_frame int, end_frame int, start_s double, end_s double, histogram array<double>")


def digests(media: DataFrame) -> DataFrame:
    """Of write_column()'s rows, read back: what they hold, how they are stored, and their shots as text."""
    kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    sha = lambda x: hashlib.sha256(x).hexdigest()

    def digest(data: bytes) -> tuple:
        spans, fps, lengths = layout(data)
        if lengths is None:
            raise ValueError("AVI without a length chunk")
        left, whole, tail, hist = lengths[0], hashlib.sha256(), b"", []
        for a, b in spans:
            held = uniform_blocks(data[a:b])
            hist.append(histogram(uniform_luma(held)))
            whole.update(held := held[:left])
            left, tail = left - len(held), (tail + held)[-64:]
        hist = np.array(hist)
        feature = ";".join(f"{a / fps:.2f}-{b / fps:.2f}:" + ",".join(f"{x:.3f}" for x in hist[a:b].mean(axis=0)) for a, b in shots(hist))
        return lengths[1], lengths[0] - left, whole.hexdigest(), zlib.crc32(tail), len(data), sha(data), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, FEW):
            columns = list(zip(*(digest(x.as_py()) for x in batch.column(1)))) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds.values()))], ["doc_id", *kinds])

    rows = media.select("doc_id", "media")
    spark_kinds = ", ".join(f"{name} {'long' if kind == pa.int64() else 'string'}" for name, kind in kinds.items())
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {spark_kinds}")
