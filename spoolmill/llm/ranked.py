"""Ranked lexical search by TPUT: three phases over postings that are partitioned by term.

The index has one row for each term that a query uses and document that holds it: the term, the document
and the value that the term adds to the document's score. It is range-partitioned and sorted by term and
falling value, so a list's head and what lies above a threshold are contiguous, and a long list is spread over files.

1. Heads: each list's ``TOP`` highest entries. The scores of their documents, looked up, are lower bounds: an item's
   ``TOP``-th highest, t1, is no more than the score that its last result has.
2. Threshold: every list of the item is read down to the same value T, the highest for which a document that isn't
   met scores less than ``ALPHA`` * t1: what a list may still hold is less than T, no more than its highest value, and nothing once it
   was read to its end. With m lists T is at least ``ALPHA`` * t1 / m. The documents that are met get a partial score and an upper bound;
   those whose bound reaches t1 are candidates. The scores of each item's ``PROBES`` best, looked up, raise the lower bound to t2.
3. Lookup: the remaining values of the candidates whose bound reaches t2 are looked up, which makes their scores exact.

An entry is shuffled once to its document, however many items want it. Items are worked on in blocks of about
``PAIRS`` (item, term) pairs, so what is broadcast of them is bounded.

Defined results: terms are maximal runs of characters other than the ASCII characters that are no letters or digits, A-Z
lower-cased; whole texts are read, in blocks. Null and empty texts have no terms: such documents don't count, such items have no
results. An item's terms count once each. Rows that share an item_id are one item with the terms of all; rows that share
a doc_id, repeated ones too, are documents of their own and ranked apart. Equal scores are ordered by doc_id, null ids last.
Scores of 0 are no results. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_spread, parts
from .jaccard import grouped
from .simhash import blocks

TOP = 10
#: (item, term) pairs of a block of items.
PAIRS = 200_000
#: Documents that are broadcast for a lookup; more are joined by a shuffle.
LOOKUPS = 2_000_000
#: Lists are read as if the lower bound were this share of itself: deeper than needed, which leaves fewer lookups.
ALPHA = 0.5
#: Candidates of an item whose scores raise its lower bound before the others are looked up.
PROBES = 100
#: Rows of a batch that a task gives back.
_ROWS = 100_000
#: Bytes as terms have them: letters and digits lower-cased, bytes of other characters, else a space.
_TERMS = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def terms(text: str | None) -> Counter:
    """How often each term occurs, as UTF-8."""
    found = Counter()
    for block in blocks((text or "").encode("utf-8", "replace").translate(_TERMS)):
        found.update(block.split())
    return found


_COUNTED = "row bigint, id bigint, n bigint, term string, tf bigint"


def counted(df: DataFrame, key: str) -> DataFrame:
    """(row, id, n, term, tf): for each row that has terms one without a term, and one for each of its terms. ``row``
    numbers the rows and is stable once written; ``n`` counts the terms of a text with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = ([], [], [], [], [])

        def told() -> pa.RecordBatch:
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.binary()).cast(k) if k == pa.string() else pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [f.split()[0] for f in _COUNTED.split(", ")])
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            for row, key_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = terms(text.as_py())
                if not found:
                    continue
                n, k = found.total(), len(found)
                out[0].extend([row] * (k + 1))
                out[1].extend([key_] + [None] * k)
                out[2].extend([n] * (k + 1))
                out[3].append(None)
                out[3].extend(found)
                out[4].append(None)
                out[4].extend(found.values())
                if len(out[0]) >= _ROWS:
                    yield told()
        if out[0]:
            yield told()

    return df.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), "text").mapInArrow(run, _COUNTED)


def weight(documents: int, holding: Column) -> Column:
    return F.floor(1000 * F.log(F.lit(2 * documents + 2) / (2 * holding + 1))).cast("long")


def value(w: Column, tf: Column, n: Column, documents: int, all_terms: int) -> Column:
    """What a term adds to a document's score: whole numbers, all divisions rounded down."""
    m = F.expr("10L") + F.call_function("div", F.lit(90).cast("long") * n * F.lit(documents).cast("long"), F.lit(all_terms).cast("long"))
    return w * F.call_function("div", F.lit(1_000_000_000).cast("long") * tf, F.lit(1000).cast("long") * tf + 8 * m)


def queries(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, item_id) and (item, term): items are numbered, and rows with one id are one item."""
    said = cut(counted(items, "item_id"))
    first = said.where("term IS NULL").groupBy(F.struct("id").alias("key")).agg(F.min("row").alias("item"))
    rows = said.where("term IS NULL").select("row", F.struct("id").alias("key")).join(first, "key")
    pairs = said.where("term IS NOT NULL").select("row", "term").join(rows.select("row", "item"), "row").select("item", "term").distinct()
    return cut(rows.select("item", F.col("key.id").alias("item_id")).distinct()), cut(pairs)


def index(docs: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings (tid, row, value) of the terms of ``vocabulary`` (tid, term), partitioned and sorted by
    term and falling value, and (row, doc_id) of all documents that have terms."""
    said = counted(docs, "doc_id")
    # rows without a term get keys of their own, which no term has
    keyed = said.withColumn("_key", F.coalesce("term", F.concat(F.lit(" "), "row")))
    held = keyed.join(vocabulary.withColumnRenamed("term", "_key"), "_key", "left").where("term IS NULL OR tid IS NOT NULL")
    held = cut(held.select("row", "id", "n", "tid", "tf"))
    own = held.where("tid IS NULL")
    documents, all_terms = own.agg(F.count("*"), F.sum("n")).first()
    lists = held.where("tid IS NOT NULL").select("tid", "row", "n", "tf")
    often = cut(lists.groupBy("tid").agg(F.count("*").alias("df")).withColumn("w", weight(documents, F.col("df"))))
    valued = join_spread(lists, often, "tid", "df").select("tid", "row", value(F.col("w"), F.col("tf"), F.col("n"), documents, all_terms or 1).alias("value"))
    order = "tid", F.desc("value"), "row"
    return cut(valued.where("value > 0").repartitionByRange(parts(valued), *order).sortWithinPartitions(*order)), own.select("row", F.col("id").alias("doc_id"))


def _kth(scores: DataFrame, score: str, out: str) -> DataFrame:
    """(item, out): the ``TOP``-th highest score of each item; items with fewer have none."""
    ranked = scores.withColumn("_r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc(score), "row")))
    return ranked.where(F.col("_r") <= TOP).groupBy("item").agg(F.min(score).alias(out), F.count("*").alias("_n")).where(F.col("_n") == TOP).select("item", out)


def _looked_up(postings: DataFrame, wanted: DataFrame, pairs: DataFrame) -> DataFrame:
    """(item, row, score): exact scores of the documents ``wanted`` (item, row)."""
    rows = cut(wanted.select("row").distinct())
    entries = postings.join(F.broadcast(rows) if rows.count() <= LOOKUPS else rows, "row", "left_semi")
    return wanted.join(entries, "row").join(F.broadcast(pairs.select("item", "tid")), ["item", "tid"], "left_semi").groupBy("item", "row").agg(F.sum("value").alias("score"))


def threshold(most: np.ndarray, last: np.ndarray, t1: int) -> int:
    """The highest value down to which lists must be read (their highest and last values are given) so that a
    document that is in none of them so far scores less than ``t1``; 0 if there is no such bound."""
    if t1 <= 0:
        return 0
    most, last = np.sort(most), np.sort(last)
    below = np.concatenate([[0], np.cumsum(most)])

    def left(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What lists that were read down to t hold at most: a sum, and how many lists t - 1 each."""
        done = np.searchsorted(most, t, "left")
        return below[done], np.searchsorted(last, t, "left") - done

    steps = np.unique(np.concatenate([[1], last + 1, most + 1]))
    fixed, open_ = left(steps)
    at = np.searchsorted(fixed + open_ * (steps - 1) >= t1, True) - 1
    end = steps[at + 1] - 1 if at + 1 < len(steps) else steps[at]
    reach = (t1 - 1 - int(fixed[at])) // int(open_[at]) + 1 if open_[at] else end
    return int(min(end, reach))


def _thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each item's lists the value down to which they are read, and what a document may have beyond."""
    for t in grouped(batches, "item"):
        most, last = np.asarray(t["most"]), np.asarray(t["last"])
        least = threshold(most, last, int(ALPHA * t["t1"][0].as_py()))
        cap = np.where(last >= least, 0, np.minimum(most, least - 1))
        yield pa.RecordBatch.from_arrays([t["item"].combine_chunks(), t["tid"].combine_chunks(), t["t1"].combine_chunks(), pa.array(np.full(len(most), least)), pa.array(cap)], ["item", "tid", "t1", "least", "cap"])


def _block(postings: DataFrame, lists: DataFrame, pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """(item, row, score) of all that can be results of the items of ``pairs`` (item, tid)."""
    # 1: lower bounds from the lists' heads
    first = cut(pairs.join(heads, "tid").select("item", "row").distinct())
    lower = _kth(_looked_up(postings, first, pairs), "score", "t1")
    asked = pairs.join(lists, "tid").join(lower, "item", "left").withColumn("t1", F.coalesce("t1", F.lit(0).cast("long"))).select("item", "tid", "most", "last", "t1")
    asked = asked.repartition(parts(asked), "item").sortWithinPartitions("item")
    asked = cut(asked.mapInArrow(_thresholds, "item bigint, tid bigint, t1 bigint, least bigint, cap bigint"))
    # 2: every list down to the same value; an entry goes to its document once
    floor = asked.groupBy("tid").agg(F.min("least").alias("floor"))
    read = postings.join(F.broadcast(floor), "tid").where(F.col("value") >= F.col("floor")).select("tid", "row", "value")
    read = read.repartition(parts(read), "row").join(F.broadcast(asked.select("item", "tid", "least", "cap")), "tid").where(F.col("value") >= F.col("least"))
    bounds = asked.groupBy("item").agg(F.sum("cap").alias("caps"), F.first("t1").alias("t1"))
    partial = read.groupBy("item", "row").agg(F.sum("value").alias("part"), F.sum("cap").alias("met")).join(F.broadcast(bounds), "item")
    partial = cut(partial.withColumn("bound", F.col("part") + F.col("caps") - F.col("met")).where(F.col("bound") >= F.col("t1")).select("item", "row", "part", "bound"))
    best = partial.withColumn("_r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("part"), "row"))).where(F.col("_r") <= PROBES)
    second = _kth(_looked_up(postings, cut(best.select("item", "row")), pairs), "score", "t2")
    candidates = partial.join(F.broadcast(second), "item", "left").where(F.col("bound") >= F.coalesce("t2", F.lit(0)))
    # 3: exact scores of the candidates
    return _looked_up(postings, cut(candidates.select("item", "row")), pairs)


def rank(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``TOP`` documents (doc_id, text) of each item (item_id, text)."""
    named, asked = queries(items)
    vocabulary = cut(asked.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()))
    postings, own = index(docs, vocabulary)
    lists = cut(postings.groupBy("tid").agg(F.max("value").alias("most"), F.min("value").alias("last")))
    by_value = Window.partitionBy("tid").orderBy(F.desc("value"), "row")
    heads = cut(postings.withColumn("_r", F.row_number().over(by_value)).where(F.col("_r") <= TOP).drop("_r"))
    pairs = cut(asked.join(vocabulary, "term").select("item", "tid"))
    blocks_of = -(-pairs.count() // PAIRS)
    found = None
    for b in range(blocks_of):
        mine = pairs if blocks_of == 1 else cut(pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks_of)) == b))
        scores = cut(_block(postings, lists, mine, heads))
        found = scores if found is None else found.unionByName(scores)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    best = found.join(own, "row").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")))
    return best.where(F.col("rank") <= TOP).join(named, "item").select("item_id", "rank", "doc_id", "score")


_SPLIT = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS ts FROM documents), u AS (SELECT * FROM t WHERE len(ts) > 0), s AS (SELECT count(*)::BIGINT AS all_docs, sum(len(ts))::BIGINT AS all_terms FROM u),
p AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf, any_value(n)::BIGINT AS n FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM u) GROUP BY r, term), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
v AS (SELECT r, doc_id, p.term, floor(1000 * ln((2 * all_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * all_docs) // all_terms))) AS value FROM p JOIN f ON f.term = p.term, s),
q AS (SELECT DISTINCT item_id, unnest({_SPLIT}) AS term FROM benchmark), x AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(value)::BIGINT AS score FROM q JOIN v ON v.term = q.term GROUP BY item_id, r)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM x WHERE score > 0) WHERE rank <= 10"""
