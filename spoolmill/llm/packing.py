"""Packing by the sum-of-squares rule, within each input partition and without a shuffle.

An online packer keeps a level array: how many open windows are filled to each level. A piece goes
to the level (or a new window) that minimises the sum of the squared counts of partially filled
windows afterwards; ties go to the fullest. Pieces longer than a window are cut into full windows
first. The rule places every piece of a partition. Only at its end, when no piece can come any more,
are the windows still open laid end to end and cut at window borders, so that a partition leaves at
most one window unfilled. Open windows hold two bytes a token (four for vocabularies of more than 65,536
ids), so a task's memory is bounded by its input split.

The result has the columns of :data:`SCHEMA` alone; other columns of the input are not read.

Defined results: a null text is empty and packs as its end id alone. Every row is packed, repeated
rows and null ids included. Empty tables give empty results. Whole texts are tokenised. A lost task
packs the same rows into the same sequences again: ids depend on the partition's number and rows.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, END = 2048, 1
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: Marks that end a chunk and then are one piece of the vocabulary's pattern.
_PUNCTUATION = ".,;:!?%&*#$|)\""


class Encoder:
    """Ids of whole texts, as little-endian uint32 bytes, by the vocabulary file ``path``.

    White space never lies inside a token of this vocabulary, so a text's ids are those of its
    space-separated chunks; two generations of chunks are remembered, ``remember`` each at most.
    A new chunk of letters, with or without closing marks, goes to the library's BPE model
    directly; any other takes the library's full path.
    """

    def __init__(self, path: str, remember: int = 400_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.remember, self.young, self.old, self.words = remember, {}, {}, {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE's characters for bytes
        rest = [b for b in range(256) if b not in set(printable)]
        self.chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.table = {b: c for b, c in self.chars.items() if chr(b) != c}

    def word(self, letters: str) -> bytes:
        """Ids of a lower-case run of letters."""
        got = self.words.get(letters)
        if got is None:
            chars = letters if letters.isascii() else letters.encode("utf-8").decode("latin-1").translate(self.table)
            got = array("I", [t.id for t in self.model.tokenize(chars)]).tobytes()
            if len(self.words) >= self.remember:
                self.words.clear()
            self.words[letters] = got
        return got

    def chunk(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8")
        core = text.rstrip(_PUNCTUATION)
        # letters only, in a form that normalisation keeps, and lower-cased letter by letter
        if core.isalpha() and (core.isascii() or unicodedata.is_normalized("NFC", core) and core.lower().isalpha() and "Σ" not in core):
            got = self.word(core.lower())
            tail = text[len(core) :]
            if not tail:
                return got
            end = self.words.get(tail)
            if end is None:
                end = self.words[tail] = array("I", [t.id for t in self.model.tokenize(tail)]).tobytes()
            return got + end
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _lookup(self, raw: bytes) -> bytes:
        got = self.young.get(raw) or self.old.get(raw)
        if got is None:
            got = self.chunk(raw)
        if len(raw) <= 64:
            if len(self.young) >= self.remember:
                self.old, self.young = self.young, {}
            self.young[raw] = got
        return got

    def __call__(self, text: str | None) -> bytes:
        chunks = (text or "").encode("utf-8", "replace").split()
        ids = list(map(self.young.get, chunks))
        if None in ids:
            for i in [i for i, x in enumerate(ids) if x is None]:
                ids[i] = self._lookup(chunks[i])
        return b"".join(ids)


class SumOfSquares:
    """One task's packer. ``put`` and ``close`` yield finished pieces as
    (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, first: int, window: int = WINDOW):
        self.window, self.next = window, first
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def put(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        n, w = len(ids), self.window
        whole = n - n % w
        for s in range(0, whole, w):
            yield doc, s, ids[s : s + w], n, self._sequence(), 0
        if n == whole:
            return
        rest = ids[whole:]
        size, piece = n - whole, (doc, whole, rest.astype(np.uint16) if rest.max() < 1 << 16 else rest.copy(), n)
        count = self.count
        levels = np.flatnonzero(count[: w - size + 1])  # level 0 is always empty
        best, level = 2 * count[size] + 1, 0
        if len(levels):
            to = levels + size
            change = 2 - 2 * count[levels] + np.where(to < w, 2 * count[to], -1)
            at = len(levels) - 1 - int(np.argmin(change[::-1]))
            if change[at] <= best:
                level = int(levels[at])
        if level:
            pieces = self.open[level].pop()
            count[level] -= 1
        else:
            pieces = []
        pieces.append(piece)
        level += size
        if level == w:
            yield from self._emit(pieces)
        else:
            self.open[level].append(pieces)
            count[level] += 1

    def _emit(self, pieces: list) -> Iterator[tuple]:
        sequence, offset = self._sequence(), 0
        for doc, start, ids, n in pieces:
            yield doc, start, ids, n, sequence, offset
            offset += len(ids)

    def close(self) -> Iterator[tuple]:
        """Lay the pieces of all open windows end to end and cut them at window borders."""
        room, batch = self.window, []
        for level in range(self.window, 0, -1):
            for pieces in self.open[level]:
                for doc, start, ids, n in pieces:
                    while len(ids):
                        head, ids = ids[:room], ids[room:]
                        batch.append((doc, start, head, n))
                        start += len(head)
                        room -= len(head)
                        if not room:
                            yield from self._emit(batch)
                            room, batch = self.window, []
            self.open[level] = []
        if batch:
            yield from self._emit(batch)
        self.count[:] = 0


def pack(df: DataFrame, tokenizer: str, text: str = "text", doc: str = "doc_id", *, window: int = WINDOW, end: int = END, remember: int = 400_000) -> DataFrame:
    """One row per piece (:data:`SCHEMA`). ``tokenizer`` is the path of a vocabulary file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer, remember)
        packer = SumOfSquares(TaskContext.get().partitionId() << 40, window)
        tail = np.asarray([end], "<u4").tobytes()
        names = [f.split()[0] for f in SCHEMA.split(", ")]

        def rows(pieces) -> Iterator[tuple]:
            for d, start, ids, n, sequence, offset in pieces:
                yield d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, sequence, offset

        def table(got: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names)

        got: list[tuple] = []
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got += rows(packer.put(d, np.frombuffer(encode(t.as_py()) + tail, "<u4")))
            if len(got) >= 4096:
                yield table(got)
                got = []
        got += rows(packer.close())
        if got:
            yield table(got)

    return df.select(F.col(doc).cast("long"), F.col(text)).mapInArrow(run, SCHEMA)
