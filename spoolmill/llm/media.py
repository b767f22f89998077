"""Media columns by signature sniffing.

One Aho-Corasick automaton over the magic bytes of all known formats finds candidate places in a
blob; a validator per format then checks structure and lengths. What passes gives the blob's true
type (whatever was declared) and carves embedded media out of it, outermost first.

Text payloads are stored losslessly as 8-bit mono PCM in a WAVE container.

Defined results: a null text is empty; empty blobs have no media. Rows are handled one by one,
repeated rows and null ids included. Empty tables give empty results. Whole texts are stored. Other
columns are not read or kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, BLOCK = 8000, 64
#: Magic bytes by format (fixed values).
MAGIC = {"wav": b"RIFF", "png": b"\x89PNG\r\n\x1a\n", "gif87": b"GIF87a", "gif89": b"GIF89a", "jpeg": b"\xff\xd8\xff", "bmp": b"BM", "zip": b"PK\x03\x04", "pdf": b"%PDF-", "gzip": b"\x1f\x8b\x08"}


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, magic in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic)))
    found.make_automaton()
    return found


def _wav(b: bytes, s: int) -> int:
    """End of a valid RIFF/WAVE file at ``s``, or 0."""
    if len(b) - s < 44 or b[s + 8 : s + 12] != b"WAVE":
        return 0
    end, at, fmt, data = s + 8 + int.from_bytes(b[s + 4 : s + 8], "little"), s + 12, False, False
    if end > len(b):
        return 0
    while at + 8 <= end:
        size = int.from_bytes(b[at + 4 : at + 8], "little")
        fmt |= b[at : at + 4] == b"fmt " and size >= 16
        data |= b[at : at + 4] == b"data" and at + 8 + size <= end
        at += 8 + size + size % 2
    return end if fmt and data and at >= end else 0


def _png(b: bytes, s: int) -> int:
    at = s + 8
    while at + 12 <= len(b):
        size = int.from_bytes(b[at : at + 4], "big")
        if at + 12 + size > len(b) or int.from_bytes(b[at + 8 + size : at + 12 + size], "big") != zlib.crc32(b[at + 4 : at + 8 + size]):
            return 0
        if at == s + 8 and b[at + 4 : at + 8] != b"IHDR":
            return 0
        if b[at + 4 : at + 8] == b"IEND":
            return at + 12
        at += 12 + size
    return 0


def _gif(b: bytes, s: int) -> int:
    if len(b) - s < 14:
        return 0
    at = s + 13 + (3 << (b[s + 10] & 7) + 1 if b[s + 10] & 128 else 0)

    def blocks(at: int) -> int:
        while at < len(b) and b[at]:
            at += b[at] + 1
        return at + 1

    while at < len(b):
        if b[at] == 0x3B:
            return at + 1
        if b[at] == 0x21:
            at = blocks(at + 2)
        elif b[at] == 0x2C and at + 10 < len(b):
            at = blocks(at + 11 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 128 else 0))
        else:
            return 0
    return 0


def _jpeg(b: bytes, s: int) -> int:
    at, scan = s + 2, False
    while at + 4 <= len(b) and b[at] == 0xFF:
        if b[at + 1] == 0xD9:
            return at + 2 if scan else 0
        scan |= b[at + 1] == 0xDA
        at += 2 + int.from_bytes(b[at + 2 : at + 4], "big")
        if scan:
            end = b.find(b"\xff\xd9", at)
            return end + 2 if end >= 0 else 0
    return 0


def _bmp(b: bytes, s: int) -> int:
    if len(b) - s < 26:
        return 0
    size, zero, pixels, header = struct.unpack_from("<IIII", b, s + 2)
    return s + size if not zero and header in (12, 40, 52, 56, 108, 124) and 14 + header <= pixels <= size <= len(b) - s else 0


def _zip(b: bytes, s: int) -> int:
    end = b.find(b"PK\x05\x06", s)
    if end < 0 or end + 22 > len(b):
        return 0
    size, offset, comment = struct.unpack_from("<IIH", b, end + 12)
    return end + 22 + comment if offset + size == end - s and end + 22 + comment <= len(b) else 0


def _pdf(b: bytes, s: int) -> int:
    end = b.rfind(b"%%EOF", s)
    return end + 5 if end > 0 and b.find(b"startxref", s) > 0 else 0


def _gzip(b: bytes, s: int) -> int:
    try:
        d = zlib.decompressobj(31)
        data = memoryview(b)[s:]
        while not d.eof:
            got = d.decompress(data, 1 << 20)
            data = d.unconsumed_tail
            if not got and not data:
                return 0
        return len(b) - len(d.unused_data)
    except zlib.error:
        return 0


VALID = {"wav": _wav, "png": _png, "gif87": _gif, "gif89": _gif, "jpeg": _jpeg, "bmp": _bmp, "zip": _zip, "pdf": _pdf, "gzip": _gzip}


def sniff(blob: bytes) -> list[tuple[str, int, int]]:
    """(format, start, end) of each medium in ``blob``, by start; media inside others are left to
    ``nested``."""
    found, free = [], 0
    for at, (kind, n) in _automaton().iter(blob.decode("latin-1")):
        s = at - n + 1
        if s >= free and (end := VALID[kind](blob, s)) > s:
            found.append((kind, s, end))
            free = end
    return found


def nested(blob: bytes) -> list[tuple[str, int, int, int]]:
    """(format, start, end, depth) of all media in ``blob``, by start and then outermost first; inside a
    medium all bytes after the first of its magic count, so a WAVE's samples do. Compressed contents aren't unpacked."""
    found, open_ = [], []
    for at, (kind, n) in _automaton().iter(blob.decode("latin-1")):
        s = at - n + 1
        while open_ and open_[-1] <= s:
            open_.pop()
        end = VALID[kind](blob, s)
        if open_ and end > open_[-1]:  # a pdf's end is searched backwards
            end = VALID[kind](blob[: open_[-1]], s)
        if end > s:
            found.append((kind, s, end, len(open_)))
            open_.append(end)
    return found


def true_type(blob: bytes, declared: str | None) -> str | None:
    """The format found at the blob's start; the declared one if there is none."""
    found = sniff(blob)
    return found[0][0] if found and found[0][1] == 0 else declared


def store(payload: bytes) -> bytes:
    """A WAVE file of 8-bit mono samples that are the payload's bytes."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(payload) % 2, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload + b"\0" * (len(payload) % 2)


def samples(blob: bytes) -> bytes:
    """The samples of the WAVE file carved out of ``blob``."""
    for kind, s, end in sniff(blob):
        if kind == "wav":
            at = s + 12
            while blob[at : at + 4] != b"data":
                size = int.from_bytes(blob[at + 4 : at + 8], "little")
                at += 8 + size + size % 2
            return blob[at + 8 : at + 8 + int.from_bytes(blob[at + 4 : at + 8], "little")]
    raise ValueError("no WAVE file found")


def features(pcm: bytes) -> str:
    """Level statistics of 8-bit samples: mean, deviation, zero crossings and peak."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"wav;n={len(x)};mean={x.mean():.4f};std={x.std():.4f};zc={crossings};peak={int(np.abs(x).max())}"


SCHEMA = "doc_id bigint, n_bytes bigint, declared string, true_type string, media binary"


def to_media(df: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Store each text, as UTF-8 and padded with zero bytes to a positive multiple of 64, as a media
    blob whose declared type is then corrected by sniffing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (t.as_py() or "").encode("utf-8", "replace")
                blob = store(raw + b"\0" * (-len(raw) % BLOCK if raw else BLOCK))
                out.append((d, len(raw), "application/octet-stream", true_type(blob, "application/octet-stream"), blob))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

    return df.select(F.col(doc).cast("long"), F.col(text)).mapInArrow(run, SCHEMA)


READ = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, true_type string"


def read_back(df: DataFrame) -> DataFrame:
    """Carve the samples out of each stored blob and digest what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, n, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                blob = blob.as_py()
                pcm = samples(blob)
                out.append((d, n, len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-BLOCK:]), len(blob), hashlib.sha256(blob).hexdigest(), features(pcm), kind))
            if out:
                kinds = [pa.string() if "string" in f else pa.int64() for f in READ.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in READ.split(", ")])

    return df.select("doc_id", "n_bytes", "true_type", "media").mapInArrow(run, READ)


CARVED = "doc_id bigint, type string, start bigint, end bigint, depth int, bytes binary"


def carve(df: DataFrame, media: str = "media", doc: str = "doc_id") -> DataFrame:
    """One row for each medium in each blob, also inside others (depth 1 and more); null blobs have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        for batch in batches:
            for d, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = blob.as_py() or b""
                for kind, s, end, depth in nested(b):
                    row = (d, kind, s, end, depth, b[s:end])
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [f.split()[0] for f in CARVED.split(", ")])

    return df.select(F.col(doc).cast("long"), F.col(media)).mapInArrow(run, CARVED)
