"""Substring search without a scan: trigram postings that are kept up by changed paths only.

An index lives in one shared folder. ``grams`` has a row for each trigram of each column of a record: the
trigram, the record's path and version, and all positions (code points). Texts are shuffled once by path; postings, which are
larger, are not: each task sorts its own in runs and appends them to a file for each bucket. Each pass appends the trigrams of the records that
changed, under its version and partitioned by a hash of the trigram; what older versions say of these records is
not touched but no longer counts. ``records`` names each record's version and size, and ``passes`` the totals; both are
written anew by a pass, ``passes`` last, so readers always see whole passes. :func:`build` starts over, which also compacts.

A query reads the partitions and row groups of its own trigrams. The lists of the rarest are intersected first; only the records
left over are looked up in the other lists, and their positions must follow one another. Numbers of records, hits and mean
sizes come from the stored totals, so ranks equal those of :func:`spoolmill.operators.search.bm25`.

Case is folded as ``lower`` does. Null columns have no trigrams. Of rows with one path in one call the one of the greatest content counts;
removing a path that isn't there does nothing. Queries of fewer than three characters have no trigrams and are an error. An index
of no records finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import COLUMNS, score, size

#: Partitions of each pass, and how many of a query's lists are intersected before the others are read.
BUCKETS, RAREST = 64, 2
#: Characters whose trigrams a task sorts at a time, rows it gives at a time; characters of a partition, and the least for which one more is made.
RUN, ROWS, MOST, LEAST = 1 << 21, 1 << 16, 1 << 25, 1 << 22
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
RECORDS = "path string, version long, size long"
PASSES = "version long, records long, sizes long"
GRAMS = "gram string, path string, part string, positions array<int>, version long, bucket int"


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _sorted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all ``texts`` in a row, which of them begin trigrams, in order of trigram, text and position, and
    for these the text and whether another trigram begins."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    inner = np.flatnonzero(owner[2:] == owner[:-2])
    # ranks among the characters that occur keep the order and take few bits, so that most keys hold the place as well
    seen = np.zeros(0x110000, np.uint64)
    seen[points] = 1
    ranks, bits, low = (np.cumsum(seen) - 1).astype(np.uint64)[points], np.uint64(int(seen.sum()).bit_length()), np.uint64(len(points).bit_length())
    keys = ((ranks[inner] << bits | ranks[inner + 1]) << bits) | ranks[inner + 2]
    if 3 * bits + low <= 64:
        keys = np.sort(keys << low | inner.astype(np.uint64))
        at, keys = (keys & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64), keys >> low
    else:
        order = np.argsort(keys, kind="stable")
        at, keys = inner[order], keys[order]
    return points, at, owner[at], np.diff(keys, prepend=~keys[:1]) != 0


def _rows(paths: list[str], sizes: list[int], parts: list[str], texts: list[str], owners: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`postings` for some records; ``owners`` has each text's record."""
    names = ["gram", "path", "part", "positions"]
    yield pa.record_batch([pa.array([""] * len(paths)), pa.array(paths), pa.array([""] * len(paths)), pa.array([[x] for x in sizes], pa.list_(pa.int32()))], names)
    if not texts:
        return
    points, at, text, new = _sorted(texts)
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    first = np.flatnonzero(new | (np.diff(text, prepend=-1) != 0))
    heads = at[new]
    spelled = np.stack([points[heads], points[heads + 1], points[heads + 2]], 1).tobytes().decode("utf-32-le")
    grams, gram = pa.array([spelled[i : i + 3] for i in range(0, len(spelled), 3)]), (np.cumsum(new) - 1)[first]
    path, part, values = pa.array([paths[i] for i in owners]), pa.array(parts), (at - starts[text]).astype(np.int32)
    ends = np.append(first[1:], len(at))
    for i in range(0, len(first), ROWS):
        some = slice(i, i + ROWS)
        begin, text_of = first[some], pa.array(text[first[some]])
        offsets = np.append(begin, ends[some][-1]) - begin[0]
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values[begin[0] : ends[some][-1]]))
        yield pa.record_batch([grams.take(pa.array(gram[some])), path.take(text_of), part.take(text_of), lists], names)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths, sizes, parts, texts, owners, held = [], [], [], [], [], 0
    for batch in batches:
        for r in range(batch.num_rows):
            paths.append(batch.column("path")[r].as_py())
            sizes.append(batch.column("size")[r].as_py())
            for c in COLUMNS:
                x = batch.column(c)[r].as_py()
                if x is not None and len(x) > 2:
                    parts.append(c)
                    texts.append(x)
                    owners.append(len(paths) - 1)
                    held += len(x)
            if held >= RUN or len(paths) >= RUN:
                yield from _rows(paths, sizes, parts, texts, owners)
                paths, sizes, parts, texts, owners, held = [], [], [], [], [], 0
    if paths:
        yield from _rows(paths, sizes, parts, texts, owners)


def postings(rows: DataFrame) -> DataFrame:
    """(gram, path, part, positions, bucket) of ``rows`` (path and :data:`COLUMNS`), in runs sorted by trigram; a row with neither gram nor part
    has the record's size in ``positions``. All of a record is in its row, so nothing is shuffled."""
    lowered = rows.select("path", size().cast("int").alias("size"), *[F.lower(c).alias(c) for c in COLUMNS])
    return lowered.mapInArrow(_index, "gram string, path string, part string, positions array<int>").withColumn("bucket", _bucket(F.col("gram")))


def _partitions(rows: DataFrame) -> int:
    """As many as the characters of ``rows`` need, so that files grow in number and not in size."""
    total = rows.agg(F.sum(sum((F.coalesce(F.length(c), F.lit(0)).cast("long") for c in COLUMNS), F.lit(0)))).first()[0] or 0
    return max(-(-total // MOST), min(rows.sparkSession.sparkContext.defaultParallelism, -(-total // LEAST)), 1)


def _last(spark: SparkSession, home: str) -> tuple[int, int, int]:
    """The last pass and its totals; zeros if there is none."""
    try:
        row = spark.read.schema(PASSES).parquet(f"{home}/passes/*").agg(F.max(F.struct("version", "records", "sizes")).alias("p")).first()["p"]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        row = None
    return (row["version"], row["records"], row["sizes"]) if row else (0, 0, 0)


def records(spark: SparkSession, home: str) -> DataFrame:
    version = _last(spark, home)[0]
    return spark.read.schema(RECORDS).parquet(f"{home}/records/{version}") if version else spark.createDataFrame([], RECORDS)


def _write(spark: SparkSession, home: str, version: int, rows: DataFrame, kept: DataFrame) -> int:
    dealt = rows.select("path", *COLUMNS).repartition(_partitions(rows), "path")
    one = dealt.groupBy("path").agg(F.max(F.struct(*COLUMNS)).alias("r")).select("path", "r.*")
    # a task keeps a file open for each bucket; else all its rows would be sorted by bucket first
    before = spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, str(BUCKETS))
    try:
        postings(one).write.partitionBy("bucket").mode("overwrite").option("compression", "zstd").parquet(f"{home}/grams/version={version}")
    finally:
        spark.conf.set(WRITERS, before)
    now = lists(spark, home, [""]).where(F.col("version") == version).select("path", "version", F.get("positions", F.lit(0)).cast("long").alias("size"))
    kept.unionByName(now).write.mode("overwrite").parquet(f"{home}/records/{version}")
    totals = spark.read.schema(RECORDS).parquet(f"{home}/records/{version}").agg(F.count("*").alias("records"), F.coalesce(F.sum("size"), F.lit(0)).alias("sizes"))
    totals.select(F.lit(version).cast("long").alias("version"), "records", "sizes").coalesce(1).write.mode("overwrite").parquet(f"{home}/passes/{version}")
    return version


def build(rows: DataFrame, home: str) -> int:
    """An index of ``rows`` alone, under the next version; what was there before no longer counts."""
    spark = rows.sparkSession
    return _write(spark, home, _last(spark, home)[0] + 1, rows, spark.createDataFrame([], RECORDS))


def update(changed: DataFrame, home: str, removed: DataFrame | None = None) -> int:
    """A pass: ``changed`` rows are new or take the place of those of their path; ``removed`` (path) go."""
    spark = changed.sparkSession
    gone = changed.select("path") if removed is None else changed.select("path").unionByName(removed.select("path"))
    kept = records(spark, home).join(gone.distinct(), "path", "left_anti")
    return _write(spark, home, _last(spark, home)[0] + 1, changed, kept)


def lists(spark: SparkSession, home: str, grams: list[str]) -> DataFrame:
    """The postings of ``grams`` in all passes: only their partitions, and in these only row groups that may hold them."""
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(_bucket(F.col("g"))).distinct().collect()]
    return spark.read.schema(GRAMS).parquet(f"{home}/grams").where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))


def matches(spark: SparkSession, home: str, query: str) -> DataFrame:
    """(path, size, found): the records that hold ``query``, how often, and their sizes."""
    q = spark.createDataFrame([(query.strip(),)], "q string").select(F.lower("q")).first()[0]
    asked = [(i, q[i : i + 3]) for i in range(len(q) - 2)]
    if not asked:
        raise ValueError("a query needs three characters")
    if not _last(spark, home)[0]:
        return spark.createDataFrame([], "path string, size long, found long")
    at: dict[str, list[int]] = {}
    for offset, gram in asked:
        at.setdefault(gram, []).append(offset)
    read = lists(spark, home, list(at))
    often = {r.gram: r.n for r in read.groupBy("gram").agg(F.count("*").alias("n")).collect()}  # a row for each of the query's trigrams
    rare = sorted(at, key=lambda g: often.get(g, 0))[:RAREST]
    key = ["path", "version", "part"]
    live = read.join(records(spark, home), ["path", "version"])
    left = live.where(F.col("gram").isin(rare)).groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select(*key)
    held = live.join(left, key, "left_semi") if len(rare) < len(at) else live
    # where the query would have to begin for each of its trigrams to be where it is
    offsets = F.create_map(*[x for g, o in at.items() for x in (F.lit(g), F.array(*map(F.lit, o)))])
    begins = held.select(*key, "size", F.explode(offsets[F.col("gram")]).alias("offset"), "positions").select(*key, "size", F.transform("positions", lambda p: p - F.col("offset")).alias("begins"))
    each = begins.groupBy(*key, "size").agg(F.collect_list("begins").alias("b")).where(F.size("b") == len(asked))  # as many as the query has trigrams
    fits = F.aggregate(F.slice("b", 2, len(asked)), F.get("b", F.lit(0)), F.array_intersect)
    return each.select("path", "size", F.size(fits).cast("long").alias("found")).groupBy("path", "size").agg(F.sum("found").alias("found")).where("found > 0")


def search(spark: SparkSession, home: str, query: str, limit: int = 50) -> DataFrame:
    """(path, score): the best ``limit`` records, the least score first, ties by path."""
    _, n, sizes = _last(spark, home)
    found = matches(spark, home, query)
    hits = found.agg(F.count("*").alias("_hits"))
    ranked = found.join(F.broadcast(hits))  # one row
    mean = F.lit(sizes / n if n else 1.0)
    return ranked.select("path", score(F.lit(n), F.col("_hits"), F.col("found"), F.col("size"), mean).alias("score")).orderBy("score", "path").limit(limit)
