"""Vector compression by codebooks: each part of a vector becomes the index of its nearest entry.

Components become whole numbers, vectors are cut into ``PARTS`` equal parts, and each part position
has a codebook of ``ENTRIES`` entries, trained by ``ROUNDS`` rounds of assignment and averaging. The nearest entry
is found by annular norm pruning: entries are sorted by norm; the one whose norm is closest to the part's gives a first
distance d; by the triangle inequality only entries whose norms lie within d of the part's can be as near, and that
annulus, found by two binary searches, is evaluated exactly, its borders included so that ties keep their lower index.

A round is one pass over the rows: tasks add up their parts by entry, and only those sums (entries times
components, once for each task) are shuffled. Codebooks are a model of a fixed size and live in the driver.
``df`` is read once for each round and once more, so give a table, not a long plan.

Defined results: rows whose vector is null or holds a null, NaN or infinite component are dropped. Vectors
that are shorter than the longest, or not a multiple of ``PARTS`` long, count as filled up with zeros; an empty vector is all zeros. The
codebooks start from the least distinct ids (of repeated ids the least vector; a null id comes last and counts once); fewer rows give
fewer entries. Ties go to the lower index. Entries that no part uses stay as they are. Repeated rows count as often as
they occur. Equal labels add up their errors, null labels together. Empty tables give empty results. Components beyond
2^26 in absolute value after scaling raise OverflowError, as sums of squares might not fit 64 bits. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_spread

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
_LIMIT = 1 << 26
#: Rows of a batch that are worked on at once.
_ROWS = 4096

Books = list[np.ndarray]


def kept(vector: Column) -> Column:
    """Whether a vector has numbers only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def whole(vector: pa.ListArray, length: int) -> np.ndarray:
    """Whole components, (rows, PARTS, length / PARTS); shorter vectors are filled up with zeros."""
    sizes = np.diff(np.asarray(vector.offsets))
    flat = np.floor(np.asarray(vector.flatten(), np.float64) * SCALE)
    if len(flat) and np.abs(flat).max() > _LIMIT:
        raise OverflowError(f"a component is beyond {_LIMIT} / {SCALE}")
    out = np.zeros((len(sizes), length), np.int64)
    out[np.arange(length)[None, :] < sizes[:, None]] = flat.astype(np.int64)
    return out.reshape(len(sizes), PARTS, -1)


def nearest(xs: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``xs`` the index of its nearest entry, and the squared distance."""
    rank = np.argsort(np.einsum("ij,ij->i", book, book), kind="stable")
    norms = np.sqrt(np.einsum("ij,ij->i", book, book)[rank].astype(float))
    own = np.sqrt(np.einsum("ij,ij->i", xs, xs).astype(float))
    # the entry of the closest norm gives a first distance
    after = np.clip(np.searchsorted(norms, own), 0, len(norms) - 1)
    before = np.clip(after - 1, 0, None)
    first = np.where(own - norms[before] <= norms[after] - own, before, after)
    gap = xs - book[rank[first]]
    best = np.sqrt(np.einsum("ij,ij->i", gap, gap).astype(float))
    # rounding may not leave out an entry on the border
    slack = 1e-9 * (1 + own + best)
    lo, hi = np.searchsorted(norms, own - best - slack, "left"), np.searchsorted(norms, own + best + slack, "right")
    wide = hi - lo
    row = np.repeat(np.arange(len(xs)), wide)
    at = np.arange(len(row)) - np.repeat(np.cumsum(wide) - wide, wide) + lo[row]
    entry = rank[at]
    gap = xs[row] - book[entry]
    dist = np.einsum("ij,ij->i", gap, gap)
    least = np.minimum.reduceat(dist, np.cumsum(wide) - wide) if len(xs) else np.zeros(0, np.int64)
    tied = np.where(dist == least[row], entry, len(book))
    index = np.minimum.reduceat(tied, np.cumsum(wide) - wide) if len(xs) else np.zeros(0, np.int64)
    return index, least


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, _ROWS):
            yield batch.slice(i, _ROWS)


def _sums(books: Books, length: int):
    """A task's sums of parts and their numbers, by part and entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = length // PARTS
        totals, often = np.zeros((PARTS, len(books[0]), width), np.int64), np.zeros((PARTS, len(books[0])), np.int64)
        for batch in _batches(batches):
            xs = whole(batch.column(0), length)
            for p in range(PARTS):
                index, _ = nearest(xs[:, p], books[p])
                np.add.at(totals[p], index, xs[:, p])
                often[p] += np.bincount(index, minlength=len(books[p]))
        p, e = np.nonzero(often)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(often[p, e]), pa.array(totals[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    return run


def _seeds(rows: DataFrame, length: int) -> Books:
    """The codebooks before the first round."""
    ids = [r.id for r in rows.select("id").distinct().orderBy(F.asc_nulls_last("id")).limit(ENTRIES).collect()]
    one = rows.where(F.col("id").isin([i for i in ids if i is not None]) | (F.col("id").isNull() if None in ids else F.lit(False)))
    first = one.groupBy("id").agg(F.min("vector").alias("vector")).orderBy(F.asc_nulls_last("id")).select("vector").collect()
    xs = whole(pa.array([r.vector for r in first], pa.list_(pa.float64())), length)
    return [xs[:, p].copy() for p in range(PARTS)]


def train(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[Books, int]:
    """The codebooks, and the length of vectors once filled up; no books if there are no rows."""
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(kept(F.col("vector")))
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return [], 0
    length = max(-(-longest // PARTS), 1) * PARTS
    books = _seeds(rows, length)
    for _ in range(ROUNDS):
        told = rows.select("vector").mapInArrow(_sums(books, length), "part int, entry int, n bigint, total array<bigint>")
        each = told.select("part", "entry", "n", F.posexplode("total").alias("i", "x")).groupBy("part", "entry", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        for r in each.collect():  # PARTS * ENTRIES * length / PARTS numbers at most
            books[r.part][r.entry, r.i] = r.x // r.n
    return books, length


def encode(df: DataFrame, books: Books, length: int, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, label, code, error): two hex digits for each part, and the squared distance to the coded vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            xs = whole(batch.column(2), length)
            found = [nearest(xs[:, p], books[p]) for p in range(PARTS)]
            codes = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(d for _, d in found), pa.int64())], [key, label, "code", "error"])

    rows = df.select(F.col(key), F.col(label), F.col(vector).cast("array<double>").alias("vector")).where(kept(F.col("vector")))
    kinds = dict(df.dtypes)
    schema = f"`{key}` {kinds[key]}, `{label}` {kinds[label]}, code string, error bigint"
    return rows.mapInArrow(run, schema) if books else df.sparkSession.createDataFrame([], schema)


def decode(code: str, books: Books) -> np.ndarray:
    """The vector that a code stands for, in the scale of the input."""
    return np.concatenate([books[p][int(code[2 * p : 2 * p + 2], 16)] for p in range(PARTS)]) / SCALE


def listed(books: Books) -> str:
    """All entries' components by part, entry and position."""
    return ",".join(str(int(x)) for book in books for x in book.reshape(-1))


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256), one row per kept row of ``df``."""
    books, length = train(df, key, vector)
    coded = cut(encode(df, books, length, key, vector, label))
    # null labels are one label
    named = coded.withColumn("_label", F.struct(label))
    totals = cut(named.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")))
    digest = hashlib.sha256(listed(books).encode()).hexdigest()
    return join_spread(named, totals, "_label", "_n").select(key, "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(table: str = "embeddings", key: str = "vec_id", vector: str = "embedding", label: str = "label") -> str:
    """The same in SQL for vectors of one length, each part compared with every entry."""

    def assign(book: str) -> str:
        return f"SELECT vec, part, unnest(arg_min(struct_pack(entry := entry, d := d, v := v), (d, entry))) FROM (SELECT p.vec, p.part, p.v, entry, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN {book} c USING (part)) GROUP BY vec, part"

    steps = [
        f"k AS MATERIALIZED (SELECT row_number() OVER () AS vec, {key} AS id, {label} AS label, list_transform({vector}, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM {table} WHERE {vector} IS NOT NULL AND len(list_filter({vector}, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec, id, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS v FROM k, range({PARTS}) t(part))",
        f"c0 AS MATERIALIZED (SELECT part, entry, v FROM (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS entry FROM p) WHERE entry < {ENTRIES})",
    ]
    for i in range(ROUNDS):
        steps += [
            f"a{i} AS MATERIALIZED ({assign(f'c{i}')})",
            f"m{i} AS (SELECT part, entry, pos, (s - ((s % n) + n) % n) // n AS x FROM (SELECT part, entry, pos, sum(v[pos])::BIGINT AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, max(len(v)) + 1)) AS pos FROM p) GROUP BY part, entry, pos))",
            f"c{i + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT part, entry, list(x ORDER BY pos) AS v FROM m{i} GROUP BY part, entry) n ON n.part = c.part AND n.entry = c.entry)",
        ]
    last = f"c{ROUNDS}"
    steps += [
        f"z AS MATERIALIZED ({assign(last)})",
        "e AS (SELECT k.id, k.label, string_agg(printf('%02x', z.entry), '' ORDER BY z.part) AS code, sum(z.d)::BIGINT AS error FROM z JOIN k USING (vec) GROUP BY k.vec, k.id, k.label)",
        f"b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS digest FROM {last})",
    ]
    return f"WITH {', '.join(steps)} SELECT id AS {key}, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM e, b"
