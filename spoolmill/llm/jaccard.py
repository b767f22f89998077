"""Self-join on the Jaccard similarity of word shingles by chosen paths.

Every distinct shingle set is embedded as 64 minhash tokens (i, value). A run starts with all sets in
one node; a node samples tokens' coordinates, each with probability 1 / (threshold * 64), and hands
its sets to one child per sampled coordinate and value, so sets that share a sampled token stay
together. Nodes of at most ``SMALL`` sets are compared by brute force. In a larger node all sets are
compared with one of them, the pivot: sets like it are joined and leave the node, sets in between
are also compared with those that left, and all others go on to the node's children. A set that is
far from the pivot is far from all that left, by the triangle inequality of the Jaccard distance.
Below the root tokens are sampled ``BRANCH`` times as often, so that a pair's chance to stay together
hardly falls with depth. The recursion ends when comparing all pairs of the nodes that are left, in
blocks, ships at most ``FULL`` times as many rows as there are sets (at the latest after ``DEPTH``).

Runs repeat until a pair at the threshold has met with the target recall. After the first run the
sets are labelled by the groups found so far, and a node whose sets are all of one group has nothing
more to tell and is dropped before its sets are read.

These comparisons use the 64 tokens and only join sets into candidate groups. Within a group all
pairs are then counted exactly, from the texts, and never emitted; each text is shipped once. A group
of at most ``BLOCK`` sets meets in one task. In a larger one, each set is described by its difference
from the group's consensus (the shingles of more than half of a sample of its sets). Sets so close to
it that any two of them reach the threshold (the core) are counted by one sum; only the differences
of the others (the rim) are compared, among themselves and with the core, in blocks.

Exact copies of a set are one set with a weight. Result per document: ``class_id``, the least doc_id
of its connected component, and ``n_links``, how many other documents reach the threshold with it.

Defined results: words are runs of non-space characters, lower-cased; a text of one to four words has
one shingle, all its words. Null and blank texts have none: their class is their own doc_id and they
have no links. Repeated rows are copies of each other. Null ids count as documents; a class of null
ids alone has a null class_id. Empty tables give empty results. Whole texts are read. Other columns
of the input, whatever their names, are kept by ``keep_one`` and not read by ``join``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, is_hot, join_spread, parts, scratch, sift

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.99
TOKENS, DEPTH, SMALL, BRANCH, FULL = 64, 12, 256, 1.5, 2
#: A candidate's estimate may be this much under the threshold (3.5 standard deviations of 64 tokens).
SLACK = 0.175
#: Sets of a candidate group that meet in one task are at most twice this many.
BLOCK = 512
#: About how many sets of a large group give its consensus.
VOTERS = 32
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sorted distinct 64-bit shingles of a text; hashes of words are remembered, up to a bound."""

    def __init__(self, words: int = WORDS, remember: int = 300_000):
        self.words, self.remember, self.known = words, remember, {}

    def __call__(self, text: str | None) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        words = (text or "").lower().encode("utf-8", "replace").split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        got = list(map(known.get, words))
        if None in got:
            if len(known) > self.remember:
                known.clear()
            for i, x in enumerate(got):
                if x is None:
                    got[i] = known[words[i]] = xxh3_64_intdigest(words[i])
        h = np.array(got, np.uint64)
        n, k = len(h), self.words
        if n < k:
            x = np.uint64(n)
            for w in h:
                x = _mixed(np.array([x * _MIX[0] + w], np.uint64))[0]
            return np.array([x], np.uint64)
        x = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            x = _mixed(x * _MIX[i % len(_MIX)] + h[i : n - k + 1 + i])
        return np.unique(x)


def set_id(shingles: np.ndarray) -> bytes | None:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _tokens(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minhash values, as int32."""
    low = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[None, s : s + 4096] * a + b).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


SETS = "doc_id bigint, text_key bigint, sid binary, n int, sk array<int>"


def _quiet(f):
    def run(*a):
        with np.errstate(over="ignore"):
            yield from f(*a)

    return run


def text_key(text: Column) -> Column:
    """With the doc_id, tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _row_key(doc: str, key: str) -> Column:
    return F.xxhash64(doc, key)


def sketches(df: DataFrame, words: int = WORDS, seed: int = 7) -> DataFrame:
    """(doc_id, text_key, sid, n, sk): a hash of the text, the set's name, its size and its tokens; null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, rng = Shingler(words), np.random.default_rng(seed)
        a = rng.integers(1, 1 << 63, (TOKENS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 1 << 63, (TOKENS, 1), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            sids, ns, sks = [], [], []
            for t in batch.column(2):
                s = shingle(t.as_py())
                sids.append(set_id(s))
                ns.append(len(s))
                sks.append(_tokens(s, a, b) if len(s) else np.zeros(TOKENS, np.int32))
            flat = pa.array(np.concatenate(sks))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, TOKENS), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sids, pa.binary()), pa.array(ns, pa.int32()), lists], ["doc_id", "text_key", "sid", "n", "sk"])

    return df.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("text_key"), "text").mapInArrow(_quiet(run), SETS)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of consecutive rows with one value of ``key``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
        start = 0
        for i, k in enumerate(keys):
            if k != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, k
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _forest(n: int, pairs: np.ndarray) -> list[int]:
    """Each item's root, the least index of its component."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(int(a)), find(int(b))
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def _alike(threshold: float):
    """Edges to each set's root among the sets of a bucket whose tokens agree often enough; in a
    bucket of two sides, pairs are of one set of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "bucket"):
            if t.num_rows < 2:
                continue
            t = t.combine_chunks()
            sk = np.asarray(t["sk"].combine_chunks().flatten()).reshape(-1, TOKENS)
            n, side, sids, cross = np.asarray(t["n"]), np.asarray(t["side"]), t["sid"].to_pylist(), t["cross"][0].as_py()
            pairs = []
            for i in range(t.num_rows - 1):
                ok = (sk[i + 1 :] == sk[i]).mean(axis=1) >= threshold - SLACK
                ok &= np.minimum(n[i + 1 :], n[i]) >= threshold * np.maximum(n[i + 1 :], n[i])
                if cross:
                    ok &= side[i + 1 :] != side[i]
                pairs += [(i, i + 1 + int(j)) for j in np.flatnonzero(ok)]
            if pairs:
                roots = _forest(t.num_rows, np.array(pairs))
                a, b = zip(*[(sids[i], sids[r]) for i, r in enumerate(roots) if sids[i] != sids[r]] or [(None, None)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def _agreement(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda a, v: a + v) / TOKENS


def runs_for(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``. A pair survives a
    level unless none of its shared sampled tokens leads on: Poisson(1) of them at the root, Poisson
    (``BRANCH``) below."""
    q = 1.0
    for _ in range(depth - 1):
        q = 1 - exp(-BRANCH * q)
    return ceil(log(1 - recall) / log(exp(-q)))


def all_pairs(rows: DataFrame, node: str, size: Column, *carry: str) -> DataFrame:
    """(bucket, side, cross, carry) so that any two rows (``sid``) of a node meet in one bucket of at
    most about twice ``BLOCK`` rows; within a row's own block all pairs count, else those of two sides."""
    nb = F.ceil(size / BLOCK)
    each = rows.withColumn("_mine", F.pmod(F.xxhash64("sid"), nb)).withColumn("_meet", F.explode(F.sequence(F.lit(0), nb - 1)))
    bucket = F.xxhash64(node, F.least("_mine", "_meet"), F.greatest("_mine", "_meet"))
    return each.select(bucket.alias("bucket"), (F.col("_mine") > F.col("_meet")).cast("int").alias("side"), (F.col("_mine") != F.col("_meet")).alias("cross"), *carry)


def two_sided(first: DataFrame, second: DataFrame, node: str, sizes: tuple[Column, Column], *carry: str) -> DataFrame:
    """The same for pairs of a row of ``first`` and one of ``second`` in the same node."""
    xs, ys = (F.ceil(x / BLOCK) for x in sizes)
    one = first.select(node, F.lit(0).alias("side"), *carry, F.pmod(F.xxhash64("sid"), xs).alias("_x"), F.explode(F.sequence(F.lit(0), ys - 1)).alias("_y"))
    two = second.select(node, F.lit(1).alias("side"), *carry, F.explode(F.sequence(F.lit(0), xs - 1)).alias("_x"), F.pmod(F.xxhash64("sid"), ys).alias("_y"))
    return one.unionByName(two).select(F.xxhash64(node, "_x", "_y", F.lit(2)).alias("bucket"), "side", F.lit(True).alias("cross"), *carry)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(parts(rows), "bucket").sortWithinPartitions("bucket", "side", "sid")


def candidates(sets: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 11) -> DataFrame:
    """Edges (a, b) that join the sets of each candidate group; ``sets`` has (sid, n, sk)."""
    rng, labelled = np.random.default_rng(seed), sets.select("sid", "sk", F.col("sid").alias("label"))
    with scratch() as keep:
        first = keep(cut(_runs(sets, labelled, range(1), rng, threshold, seed)))
    with scratch() as keep:
        group = components(first).select(F.col("node").alias("sid"), "root")
        labelled = keep(cut(sets.select("sid", "sk").join(group, "sid", "left").select("sid", "sk", F.coalesce("root", "sid").alias("label"))))
    with scratch() as keep:
        return first.unionByName(keep(cut(_runs(sets, labelled, range(1, runs_for(recall)), rng, threshold, seed))))


def _runs(sets: DataFrame, labelled: DataFrame, runs: range, rng: np.random.Generator, threshold: float, seed: int) -> DataFrame:
    """The edges found by ``runs``."""
    rate = max(1, round(threshold * TOKENS))  # a coordinate is sampled by one node in so many
    chosen = [(r, i) for r in runs for i in np.flatnonzero(rng.integers(0, rate, TOKENS) == 0).tolist() or [int(rng.integers(0, TOKENS))]]
    roots = F.array(*[F.xxhash64(F.lit(r), F.lit(i), F.get("sk", F.lit(i))) for r, i in chosen])
    rows = labelled.select("sid", "label", F.explode(roots).alias("node"))
    tokens = sets.select("sid", "n", "sk")
    found, met, total = [], [], sets.count()

    def union() -> DataFrame:
        near = _dealt(reduce(DataFrame.unionByName, met).join(tokens, "sid"))
        pairs = near.select("bucket", "sid", "side", "cross", "n", "sk").mapInArrow(_alike(threshold), "a binary, b binary").where("a IS NOT NULL")
        return reduce(DataFrame.unionByName, [pairs, *found]).distinct()

    for level in range(1, DEPTH + 1):
        labels = F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")
        counts = cut(rows.groupBy("node").agg(*labels).where("m > 1 AND lo <> hi").select("node", "m"))
        # most rows are alone in their node, or among their own group
        rows = cut(join_spread(sift(rows, F.col("node"), counts, F.col("node")), counts, "node", "m"))
        small = rows.where(F.col("m") <= SMALL).groupBy("node").agg(F.sort_array(F.collect_list("sid")).alias("sids"))
        small = small.select("sids").distinct().select(F.xxhash64("sids").alias("bucket"), F.explode("sids").alias("sid"))
        met.append(small.select("bucket", "sid", F.lit(0).alias("side"), F.lit(False).alias("cross")))
        rows = rows.where(F.col("m") > SMALL)
        ships = counts.where(F.col("m") > SMALL).agg(F.sum(F.col("m") * F.ceil(F.col("m") / BLOCK))).first()[0]
        if ships is not None and (ships <= FULL * total or level == DEPTH):
            met.append(all_pairs(rows.select("node", "sid", "m"), "node", F.col("m"), "sid"))
        if ships is None or ships <= FULL * total or level == DEPTH:
            return union()
        # the least set of a node is its pivot, so nodes of one group mostly share theirs
        pivots = rows.groupBy("node").agg(F.min("sid").alias("pivot"), F.count("*").alias("m"))
        about = tokens.select(F.col("sid").alias("pivot"), F.col("sk").alias("psk"))
        pivots = cut(pivots.join(about, "pivot"))
        like = _agreement(F.col("sk"), F.col("psk"))
        held = join_spread(rows.select("node", "sid", "label").join(tokens.select("sid", "sk"), "sid"), pivots, "node", "m")
        held = cut(held.select("node", "sid", "label", "sk", "pivot", like.alias("like")))
        gone = F.col("like") >= threshold - SLACK
        between = ~gone & (F.col("like") >= 2 * threshold - 1 - 1.5 * SLACK)
        found.append(held.where(gone & (F.col("sid") != F.col("pivot"))).select(F.col("sid").alias("a"), F.col("pivot").alias("b")).distinct())
        sizes = held.groupBy("node").agg(F.count_if(gone).alias("p"), F.count_if(between).alias("q")).where("p > 1 AND q > 0")
        sizes = cut(sizes.withColumn("m", F.col("p") + F.col("q")))
        if not sizes.isEmpty():
            edge = join_spread(held.where(gone | between).select("node", "sid", "like"), sizes, "node", "m")
            met.append(two_sided(edge.where(between), edge.where(gone), "node", (F.col("q"), F.col("p")), "sid"))
        rest, often = held.where(~gone), round(1000 * BRANCH / rate)
        picked = F.filter(F.sequence(F.lit(0), F.lit(TOKENS - 1)), lambda i: F.pmod(F.xxhash64(F.col("node"), i, F.lit(seed)), F.lit(1000)) < often)
        rows = rest.select("sid", "label", F.explode(F.transform(picked, lambda i: F.xxhash64(F.col("node"), i, F.get(F.col("sk"), i)))).alias("node"))
    return union()


def _with_least(edges: DataFrame, hot: bool) -> DataFrame:
    """``edges`` (a, b) with ``m``, the least of a and its neighbours b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n")).select("a", F.least("a", "m").alias("m"), "_n")
    return join_spread(edges, cut(least), "a", "_n") if hot else edges.join(least, "a")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the least node of its component.

    Large-star and small-star steps alternate until all edges lead from a node to its root; each is one
    aggregation and one join of edges, and a round is written. Nodes of very many edges are joined apart.
    """
    ends = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    e = cut(edges.where("a <> b").select(*ends).distinct())
    while True:
        seen = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        degrees = seen.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        open_ = (F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)
        going, most, total = degrees.agg(F.count_if(open_), F.max(F.col("up") + F.col("down")), F.sum(F.col("up") + F.col("down"))).first()
        if not going:
            break
        hot = is_hot(most, total)  # no step makes a node of more neighbours than these
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, hot).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = _with_least(cut(large) if hot else large, hot).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        e = cut(small.select("x.*").where("a <> b").distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _count(sizes: np.ndarray, deltas: list[np.ndarray], threshold: float, side: np.ndarray | None) -> np.ndarray:
    """Which of some sets are linked, from their sizes and their differences from one common set."""
    m, d = len(deltas), np.array([len(x) for x in deltas], float)
    shared = np.zeros((m, m), np.float32)
    values, column, often = np.unique(np.concatenate(deltas), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), [len(x) for x in deltas])
    twice = often > 1  # what one set alone has is shared with none
    place = np.cumsum(twice) - 1
    kept = twice[column]
    column, owner = place[column[kept]], owner[kept]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = max(64, (1 << 23) // m)
    for c in range(0, int(twice.sum()), width):
        lo, hi = np.searchsorted(column, [c, c + width])
        dense = np.zeros((m, int(min(width, twice.sum() - c))), np.float32)
        dense[owner[lo:hi], column[lo:hi] - c] = 1
        shared += dense @ dense.T
    total = sizes[:, None] + sizes[None, :]
    common = (total - d[:, None] - d[None, :]) / 2 + shared
    linked = common >= threshold * (total - common) - 1e-6
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    return linked


LINKS = "a binary, b binary, links bigint"


def _linked(threshold: float, words: int = 0):
    """Links by weight and the root of each set of a bucket: from whole texts if ``words`` is given,
    else from differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words) if words else None
        for t in grouped(batches, "bucket"):
            members = {}
            what = t["text"] if words else t["delta"]
            for sid, w, n, side, x in zip(t["sid"].to_pylist(), t["w"].to_pylist(), t["n"].to_pylist(), t["side"].to_pylist(), what, strict=True):
                if sid not in members:
                    x = x.as_py()
                    x = shingle(x) if words else np.frombuffer(x, np.uint64)
                    if not words or set_id(x) == sid:
                        members[sid] = (w, n, side, x)
            if len(members) < 2:
                continue
            sids, (ws, ns, sides, deltas) = list(members), zip(*members.values(), strict=True)
            linked = _count(np.array(ns, float), deltas, threshold, np.array(sides) if t["cross"][0].as_py() else None)
            roots, links = _forest(len(sids), np.argwhere(np.triu(linked))), linked @ np.array(ws, np.int64)
            keep = [i for i in range(len(sids)) if links[i]]
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array([sids[i] for i in keep], pa.binary()), pa.array([sids[roots[i]] for i in keep], pa.binary()), pa.array([int(links[i]) for i in keep], pa.int64())], ["a", "b", "links"])

    return run


def _consensus(words: int):
    """For each ``bucket``, the sorted shingles of more than half of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for t in grouped(batches, "bucket"):
            values, often = np.unique(np.concatenate([shingle(x.as_py()) for x in t["text"]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([t["root"].combine_chunks()[:1], pa.array([values[2 * often > t.num_rows].tobytes()], pa.binary())], ["root", "pivot"])

    return run


DELTAS = "root binary, sid binary, w bigint, n int, d int, delta binary"


def _deltas(words: int):
    """Each set's difference from its group's consensus, which comes first in a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, none = Shingler(words), np.empty(0, np.uint64)
        at, pivot = None, none
        for batch in batches:
            out = []
            for bucket, root, sid, w, known, text in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5), strict=True):
                if bucket != at:
                    at, pivot = bucket, none
                if known is not None:
                    pivot = np.frombuffer(known, np.uint64)
                elif set_id(s := shingle(text.as_py())) == sid:
                    delta = np.setxor1d(s, pivot, assume_unique=True)
                    out.append((root, sid, w, len(s), len(delta), delta.tobytes()))
            if out:
                kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in DELTAS.split(", ")])

    return run


def _links(texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """(a, b, links): for each linked set a, a set b of its component and links by weight (summed over
    the rows of a). ``texts`` has (root, size, sid, w, n, text), one row per set of a group."""
    flags = F.lit(0).alias("side"), F.lit(False).alias("cross")
    small = texts.where(F.col("size") <= BLOCK).select(F.col("root").alias("bucket"), *flags, "sid", "w", "n", "text")
    found = _dealt(small).mapInArrow(_quiet(_linked(threshold, words)), LINKS)
    large = texts.where(F.col("size") > BLOCK)
    if large.isEmpty():
        return found
    voters = large.where(F.pmod(F.xxhash64("sid", F.lit(5)), F.col("size")) < VOTERS)
    votes = voters.select(F.xxhash64("root").alias("bucket"), "root", *flags, "sid", "text")
    pivots = cut(_dealt(votes).mapInArrow(_quiet(_consensus(words)), "root binary, pivot binary"))
    salts = F.ceil(F.col("size") / BLOCK)
    sizes = large.select("root", "size").distinct()
    first = pivots.join(sizes, "root").select(F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "root", F.lit(None).cast("binary").alias("sid"), F.lit(0).cast("long").alias("w"), "pivot", F.lit(None).cast("string").alias("text"))
    rows = first.unionByName(large.select(F.pmod(F.xxhash64("sid"), salts).alias("salt"), "root", "sid", "w", F.lit(None).cast("binary").alias("pivot"), "text"))
    rows = rows.select(F.xxhash64("root", "salt").alias("bucket"), "root", "sid", "w", "pivot", "text")
    # nulls sort first, so a bucket begins with its group's consensus
    deltas = cut(rows.repartition(parts(rows), "bucket").sortWithinPartitions("bucket", "sid").mapInArrow(_quiet(_deltas(words)), DELTAS))
    core = F.col("d") * (1 + threshold) <= F.col("n") * (1 - threshold) + 1e-9
    about = deltas.groupBy("root").agg(F.sum(F.when(core, F.col("w")).otherwise(0)).alias("weight"), F.min(F.when(core, F.col("sid"))).alias("least"), F.count_if(core).alias("p"), F.count_if(~core).alias("q"), F.count("*").alias("_n"))
    each = cut(join_spread(deltas, cut(about), "root", "_n"))
    found = found.unionByName(each.where(core & (F.col("p") > 1)).select(F.col("sid").alias("a"), F.col("least").alias("b"), (F.col("weight") - F.col("w")).alias("links")))
    carry = ("sid", "w", "n", "delta")
    rim = all_pairs(each.where(~core), "root", F.col("q"), *carry)
    rim = rim.unionByName(two_sided(each.where(~core & (F.col("p") > 0)), each.where(core & (F.col("q") > 0)), "root", (F.col("q"), F.col("p")), *carry))
    return found.unionByName(_dealt(rim).mapInArrow(_quiet(_linked(threshold)), LINKS))


def join(df: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, text_key, class_key), one row per row of ``df`` (doc_id, text).

    ``class_key`` names the component also where ids are null or repeated; null for texts without words.
    """
    docs = cut(sketches(df, words))
    with scratch() as keep:
        table = keep(cut(_classes(df, docs, threshold, words, recall)))
    out = join_spread(docs.where("sid IS NOT NULL").select("doc_id", "text_key", "sid"), table, "sid", "w")
    out = out.select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"), "text_key", "class_key")
    none = docs.where("sid IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "text_key", F.lit(None).cast("binary").alias("class_key"))
    return out.unionByName(none)


def _classes(df: DataFrame, docs: DataFrame, threshold: float, words: int, recall: float) -> DataFrame:
    """(sid, w, class_key, class_id, n_links) of each set of the rows ``df``, whose sketches are ``docs``."""
    sets = docs.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc"), F.min(F.struct("doc_id", "text_key")).alias("row"), F.count("*").alias("w"), F.first("n").alias("n"), F.first("sk").alias("sk"))
    sets = cut(sets)
    with scratch() as keep:
        group = keep(cut(components(candidates(sets, threshold, recall))))
    size = cut(group.groupBy("root").agg(F.count("*").alias("size")))
    member = cut(join_spread(group, size, "root", "size").withColumnRenamed("node", "sid").join(sets.select("sid", "row", "w", "n"), "sid"))
    # a set fetches the text of one row; the id alone may be null or repeated
    text = df.select(F.col("doc_id").cast("long").alias("_doc"), text_key(F.col("text")).alias("_key"), "text")
    text = sift(text, _row_key("_doc", "_key"), member, _row_key("row.doc_id", "row.text_key"))
    texts = text.join(member, (F.col("_key") == F.col("row.text_key")) & F.col("_doc").eqNullSafe(F.col("row.doc_id")))
    texts = texts.select("root", "size", "sid", "w", "n", "text")
    # rows that are repeated with their id would each give their set again; where there are any, tasks keep one of each
    again = docs.where("sid IS NOT NULL").groupBy("doc_id", "text_key").agg(F.count("*").alias("c")).where("c > 1")
    if not again.isEmpty():
        texts = texts.groupBy("root", "size", "sid", "w", "n").agg(F.first("text").alias("text"))
    with scratch() as keep:
        found = keep(cut(_links(cut(texts), threshold, words)))
    links = found.groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links"))
    own = cut(components(found.select("a", "b")))
    least = own.join(sets.select(F.col("sid").alias("node"), "doc"), "node").groupBy("root").agg(F.min("doc").alias("class_doc"), F.count("*").alias("_n"))
    known = join_spread(own, cut(least), "root", "_n").select(F.col("node").alias("sid"), "root", "class_doc").join(links, "sid", "left")
    table = sets.select("sid", "doc", "w").join(known, "sid", "left")
    return table.select("sid", "w", F.coalesce("root", "sid").alias("class_key"), F.when(F.col("root").isNull(), F.col("doc")).otherwise(F.col("class_doc")).alias("class_id"), (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def keep_one(df: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """One row of each class: that of the least doc_id (null ids last; of repeated rows any one).
    Texts without words all stay. The columns are those of ``df``."""
    with scratch() as keep:
        joined = keep(cut(join(df, threshold, words, recall)))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best")
    many = joined.where("class_key IS NOT NULL").groupBy("class_key").agg(best, F.count("*").alias("c")).where("c > 1")
    won = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    lost = join_spread(joined.select("doc_id", "text_key", "class_key"), cut(many), "class_key", "c").where(~won)
    lost = cut(lost.select(F.col("doc_id").alias("lost_doc"), F.col("text_key").alias("lost_key")).distinct())
    keyed = df.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("key"))
    sieve = _row_key("id", "key"), lost, _row_key("lost_doc", "lost_key")
    same = F.col("id").eqNullSafe(F.col("lost_doc")) & (F.col("key") == F.col("lost_key"))
    # rows that surely haven't lost stay where they are
    kept = sift(keyed, *sieve, out=True).unionByName(sift(keyed, *sieve).join(lost, same, "left_anti"))
    again = joined.where("class_key IS NOT NULL").groupBy("doc_id", "text_key").agg(F.count("*").alias("c")).where("c > 1")
    if not again.isEmpty():
        # of repeated rows each task keeps one, before they meet; texts without words all stay
        again = cut(again.select(F.col("doc_id").alias("twice_doc"), F.col("text_key").alias("twice_key")))
        sieve = _row_key("id", "key"), again, _row_key("twice_doc", "twice_key")
        blank = F.trim(F.translate(F.coalesce("row.text", F.lit("")), "\t\n\x0b\x0c\r", "     ")) == ""
        apart = F.when(blank, F.monotonically_increasing_id())
        one = sift(kept, *sieve).groupBy("id", "key", apart.alias("apart")).agg(F.first("row").alias("row"))
        kept = sift(kept, *sieve, out=True).select("row").unionByName(one.select("row"))
    return kept.select("row.*")
