"""Near duplicates at a size where nodes split, groups are large and keys are hot."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoolmill.llm import common, jaccard


def links_of(texts, threshold=0.8):
    """Which texts are linked, from their shingle sets."""
    shingle = jaccard.Shingler()
    with np.errstate(over="ignore"):
        sets = [shingle(t) for t in texts]
    values, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    dense = np.zeros((len(sets), len(values)), np.float32)
    dense[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), column] = 1
    shared = dense[:, often > 1] @ dense[:, often > 1].T
    size = np.array([len(s) for s in sets], float)
    linked = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-6
    linked &= size[:, None] > 0
    np.fill_diagonal(linked, False)
    return linked


def classes_of(linked, ids):
    out, left = {}, set(range(len(ids)))
    while left:
        seen, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            seen.add(i)
            new = set(np.flatnonzero(linked[i]).tolist()) & left
            left -= new
            todo += new
        least = min(ids[i] for i in seen)
        out |= {i: least for i in seen}
    return [out[i] for i in range(len(ids))]


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(160)]
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(1200):  # one group of near copies, some of them far from its middle
        words = list(base)
        for i in rng.integers(0, 160, rng.integers(0, 8)):
            words[i] = f"x{rng.integers(1_000_000)}"
        texts.append(" ".join(words))
    for k in range(300):  # pairs on both sides of the threshold
        words = [f"q{k}.{i}" for i in range(200)]
        other = list(words)
        for i in rng.choice(20, rng.integers(1, 6), replace=False):
            other[10 * i] = f"y{k}.{i}"
        texts += [" ".join(words), " ".join(other)]
    texts += [" ".join([*passage, *(f"z{k}.{i}" for i in range(140))]) for k in range(400)]  # a common passage
    texts += [texts[0]] * 20 + [""] * 5
    return [(7 * i + 1, t) for i, t in enumerate(texts)]


def test_large_groups_links_and_recall(spark, planted, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 32)
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    monkeypatch.setattr(common, "HOT", 50)
    monkeypatch.setattr(jaccard, "FULL", 0.5)  # so that the recursion goes deep
    df = spark.createDataFrame(planted, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(df).collect()}
    ids, texts = zip(*planted, strict=True)
    linked = links_of(texts)
    want = dict(zip(ids, zip(classes_of(linked, ids), linked.sum(axis=1).tolist(), strict=True), strict=True))
    assert len(got) == len(want)
    # of the near copies none is lost, and their links are exact
    assert all(got[i] == want[i] for i in ids[:1200])
    pairs = [i for i in ids[1200:1800] if want[i][1]]
    assert len(pairs) > 400 and sum(got[i] == want[i] for i in pairs) >= 0.99 * len(pairs)
    assert all(got[i] == want[i] for i in ids[1800:])


def test_runs_repeat_until_the_recall():
    assert jaccard.runs_for(0.99, 1) == 5 and jaccard.runs_for(0.99, 2) == 6 and jaccard.runs_for(0.99, 12) == jaccard.runs_for(0.99, 40) == 8


def test_sift_keeps_all_keys_and_few_others(spark, monkeypatch):
    df = spark.range(40_000).selectExpr("id AS doc", "xxhash64(id) AS h")
    keys = common.cut(spark.range(0, 40_000, 10).selectExpr("id AS k"))
    sieve = F.col("h"), keys, F.xxhash64("k")
    kept = {r.doc for r in common.sift(df, *sieve).collect()}
    wanted = set(range(0, 40_000, 10))
    assert wanted <= kept and len(kept - wanted) < 0.1 * 36_000
    assert {r.doc for r in common.sift(df, *sieve, out=True).collect()} == set(range(40_000)) - kept
    none = common.cut(keys.where("k < 0"))
    assert common.sift(df, F.col("h"), none, F.xxhash64("k")).isEmpty()
    assert common.sift(df, F.col("h"), none, F.xxhash64("k"), out=True).count() == 40_000
    monkeypatch.setattr(common, "SIEVE_BITS", 64)  # keys that outgrow the bitmap only let more rows pass
    assert wanted <= {r.doc for r in common.sift(df, *sieve).collect()}


@pytest.mark.parametrize("bits", [1 << 28, 8])
def test_keep_one_of_repeated_and_blank_rows(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "SIEVE_BITS", bits)
    long = " ".join(f"w{i}" for i in range(100))
    near, other = long + " more", " ".join(f"v{i}" for i in range(50))
    rows = [(5, long), (5, long), (3, near), (3, near), (9, long), (7, other), (None, other), (8, ""), (8, ""), (8, " \n"), (None, None), (None, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row int").repartition(4)
    got = jaccard.keep_one(df)
    assert got.columns == df.columns
    left = [(r.doc_id, r.text) for r in got.collect()]
    want = [(3, near), (7, other), (8, ""), (8, ""), (8, " \n"), (None, None), (None, None)]
    assert sorted(left, key=str) == sorted(want, key=str)
