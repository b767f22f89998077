"""Near duplicates by SimHash: fingerprints at two or fewer differing bits link, links make components.

A fingerprint is embedded as its segments' bit counts: ``s`` segments of 64 / s bits make a point of an
s-dimensional grid. Two fingerprints' Manhattan distance there is a lower bound of their Hamming distance,
so linked ones lie within ``BITS`` = 2 of each other, and then some grid point lies within 1 of both. Every
distinct fingerprint is entered under its own point and the 2 s points around it; fingerprints that meet
under a point are candidates and are compared exactly.

A point under which more than ``CROWD`` fingerprints meet isn't compared: those fingerprints are embedded
again with finer segments (16, 32, then 64). With segments of one bit the bound is the Hamming distance
itself: all under a point are within 1 of it, so they are linked to the least of them without comparing.
So the work is linear in fingerprints, whatever their groups, and no link is lost.

Defined results: words are runs of characters other than space and U+0009..U+000D, after A-Z are lower-cased;
shingles are three words joined by a space, with repeats; a text of one or two words has one shingle, all its words. Null and
blank texts have the fingerprint zero, which links like any other. A bit is set if it is set in more than half
of the shingles' XXH64 values (seed 42). Whole texts are read, in blocks. Equal texts and repeated rows
are one fingerprint and one component. ``component_id`` is the least doc_id of the component; null ids count only where
a component has no other, which gives null. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_spread, parts
from .jaccard import _forest, components, grouped

WORDS, SEED = 3, 42
#: Differing bits at which fingerprints still link; the grid's range of 1 on either side is half of it.
BITS = 2
#: Segments of the embeddings, coarse to fine; the last must be one bit each.
SEGMENTS = (16, 32, 64)
#: Fingerprints under one point that are compared with each other; more are embedded again.
CROWD = 64
#: Bytes of a text that are split into words at once, and shingles whose bits are counted at once.
_BYTES, _SHINGLES = 1 << 20, 1 << 14
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def blocks(text: bytes, size: int = _BYTES) -> Iterator[bytes]:
    """``text`` in blocks that end between words, of about ``size`` bytes or one word."""
    at = 0
    while len(text) - at > size and (space := _SPACE.search(text, at + size)):
        yield text[at : space.start()]
        at = space.start()
    yield text[at:]


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned fingerprint of one text."""
    from xxhash import xxh64_intdigest

    held: list[bytes] = []
    ones, total = np.zeros(64, np.int64), 0

    def add(hashes: list[int]) -> None:
        nonlocal total
        total += len(hashes)
        for i in range(0, len(hashes), _SHINGLES):
            x = np.array(hashes[i : i + _SHINGLES], np.uint64)
            ones[:] += np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)

    for block in blocks((text or "").encode("utf-8", "replace").translate(_LOWER)):
        held += block.split()
        if len(held) >= words:
            # shingles are slices of the words joined once
            joined = b" ".join(held)
            ends = np.cumsum([len(x) + 1 for x in held]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            add([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(held) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)])
            held = held[len(held) - words + 1 :]
    if not total and held:
        add([xxh64_intdigest(b" ".join(held), SEED)])
    return int(sum(1 << i for i in range(64) if 2 * ones[i] > total))


def fingerprints(df: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): ``fp`` is the fingerprint's 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _mask(low: int, width: int) -> Column:
    bits = ((1 << width) - 1) << low
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")


def points(fps: DataFrame, segments: int) -> DataFrame:
    """(fp, point): the grid points within 1 of each fingerprint's segment counts, each as one number whose
    digits to the base 64 / segments + 1 are the counts. Points outside the grid lie between no two fingerprints."""
    width, fp = 64 // segments, F.col("fp")
    if width == 1:  # counts are bits, and their number is the fingerprint itself
        return fps.select("fp", F.explode(F.array(fp, *[fp.bitwiseXOR(_mask(i, 1)) for i in range(64)])).alias("point"))
    base = width + 1
    counts = [F.bit_count(fp.bitwiseAND(_mask(i * width, width))) for i in range(segments)]
    own = sum((c.cast("long") * F.lit(base**i).cast("long") for i, c in enumerate(counts)), F.lit(0).cast("long"))
    more = [F.when(c < width, F.lit(base**i).cast("long")) for i, c in enumerate(counts)]
    less = [F.when(c > 0, F.lit(-(base**i)).cast("long")) for i, c in enumerate(counts)]
    near = fps.select("fp", own.alias("own"), F.array(F.lit(0).cast("long"), *more, *less).alias("steps"))
    return near.select("fp", "own", F.explode("steps").alias("step")).where("step IS NOT NULL").select("fp", (F.col("own") + F.col("step")).alias("point"))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact comparison of the fingerprints under each point: an edge to each one's root."""
    for t in grouped(batches, "point"):
        if t.num_rows < 2:
            continue
        fps = np.unique(np.asarray(t["fp"].combine_chunks()))
        near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= BITS
        roots = _forest(len(fps), np.argwhere(np.triu(near, 1)))
        found = [(int(fps[i]), int(fps[r])) for i, r in enumerate(roots) if i != r]
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) that join the distinct fingerprints ``fps`` (fp) as their links do."""
    found = None
    for segments in SEGMENTS:
        met = points(fps.select("fp"), segments)
        # counted before anything is gathered; nearly all points have one fingerprint
        seen = cut(met.groupBy("point").agg(F.count("*").alias("n"), F.min("fp").alias("least")).where("n > 1"))
        held = join_spread(met, seen, "point", "n")
        if segments == SEGMENTS[-1]:
            edges = held.where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()
            return cut(edges if found is None else found.unionByName(edges))
        held = cut(held.select("fp", "point", "n"))
        small = held.where(F.col("n") <= crowd).select("point", "fp")
        edges = cut(small.repartition(parts(small), "point").sortWithinPartitions("point").mapInArrow(_verified, "a bigint, b bigint").distinct())
        found = edges if found is None else found.unionByName(edges)
        fps = cut(held.where(F.col("n") > crowd).select("fp").distinct())
        if fps.isEmpty():
            return found
    return found


def near_duplicates(df: DataFrame, words: int = WORDS, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``df`` (doc_id, text)."""
    docs = cut(fingerprints(df, words))
    distinct = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n")))
    own = cut(components(links(distinct.select("fp"), crowd)))
    known = distinct.join(own.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "doc", "n", F.coalesce("root", "fp").alias("root"))
    known = cut(known)
    least = cut(known.groupBy("root").agg(F.min("doc").alias("component_id"), F.count("*").alias("_n")))
    table = cut(join_spread(known, least, "root", "_n").select("fp", "component_id", "n"))
    out = join_spread(docs, table, "fp", "n")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
