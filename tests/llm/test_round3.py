"""SimHash, vector codes and ranked search against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from spoolmill.llm import codes, queries, ranked, simhash

from ..compare import same

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(root)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    return {f: find(f) for f in fps}


def check_components(got, rows):
    """rows: (doc_id, fingerprint)."""
    root = plain_components([f for _, f in rows])
    least = {}
    for i, f in rows:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted((repr(i), f"{f:016x}", repr(least.get(root[f]))) for i, f in rows)
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in got) == want


def test_fingerprints_of_whole_texts(spark):
    texts = [None, "", " \n", "One", "one TWO", "a b c", "É é A", "x y z w", "a b c a b c " * 40, "w" * 300 + " " + "v " * 5000]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t), t
    long = " ".join(random.Random(1).choices(["ab", "Cde", "f", "x" * 50], k=9000))
    assert [len(b) for b in simhash.blocks(b"aa bb cccc d", 3)] == [5, 5, 2] and b"".join(simhash.blocks(long.encode(), 100)).decode() == long
    whole, simhash_bytes = simhash.fingerprint(long), simhash.blocks.__defaults__
    simhash.blocks.__defaults__ = (100,)
    try:
        assert simhash.fingerprint(long) == whole == plain_fingerprint(long)
    finally:
        simhash.blocks.__defaults__ = simhash_bytes


def test_simhash_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check_components(queries.op11_simhash(spark, SF).collect(), [(r.doc_id, plain_fingerprint(r.text)) for r in rows])


@pytest.mark.parametrize("crowd", [64, 3])
def test_links_of_crowds_and_chains(spark, crowd):
    rng = random.Random(crowd)
    fps = {rng.getrandbits(64) for _ in range(200)}
    middle = rng.getrandbits(64)
    for _ in range(300):  # a crowd around one fingerprint, some of it linked and some not
        fps.add(middle ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    chain = 0
    for i in range(30):
        chain ^= 3 << 2 * i
        fps.add(chain)
    fps |= {0, (1 << 64) - 1, (1 << 64) - 2, 1 << 63}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    root = plain_components(fps)
    found = simhash.components(simhash.links(spark.createDataFrame(signed, "fp bigint").repartition(4), crowd)).collect()
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in found}
    groups = lambda of: {frozenset(x for x in fps if of(x) == r) for r in {of(x) for x in fps}}
    assert groups(lambda x: got.get(x, x)) == groups(root.get)


def test_simhash_odd_rows(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, None), (3, ""), (None, "q r s t u v"), (None, "q r s t u v"), (7, "one")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    check_components(simhash.near_duplicates(df).collect(), [(i, plain_fingerprint(t)) for i, t in rows])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def plain_codes(vectors):
    """Entries and codes of (id, vector) rows, in whole numbers of Python."""
    rows = [(i, [int(np.floor(4096 * x)) for x in v]) for i, v in vectors]
    parts = [[v[p * len(v) // 8 : (p + 1) * len(v) // 8] for _, v in rows] for p in range(8)]
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])[:16]
    books, dist = [[xs[k] for k in order] for xs in parts], lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda e: (dist(x, book[e]), e))
    for _ in range(6):
        for p, xs in enumerate(parts):
            at = [near(x, books[p]) for x in xs]
            for e in set(at):
                mine = [x for x, a in zip(xs, at, strict=True) if a == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    codes_, errors = [], []
    for k in range(len(rows)):
        at = [near(parts[p][k], books[p]) for p in range(8)]
        codes_.append("".join(f"{a:02x}" for a in at))
        errors.append(sum(dist(parts[p][k], books[p][a]) for p, a in enumerate(at)))
    return codes_, errors, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_vector_codes_query_and_its_sql(spark):
    assert same(queries.op12_vector_codes(spark, SF), queries.ORACLES["op12_vector_codes"], SF) > 0


def test_vector_codes_against_brute_force_with_ties(spark):
    rng = random.Random(5)
    vectors = [(i, [rng.choice([-0.25, 0.0, 0.1, 0.25, 1.0]) for _ in range(16)]) for i in range(120)]
    vectors += [(200 + i, vectors[3][1]) for i in range(40)]  # one very common vector
    rows = [(i, v, None if i % 5 == 0 else i % 3, "x") for i, v in vectors]
    bad = [(-1, None, 1, "x"), (-2, [None] * 16, 1, "x"), (-3, [float("nan")] * 16, 1, "x"), (-4, [float("inf")] + [0.0] * 15, 1, "x")]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    exact = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in vectors]
    want_codes, errors, digest = plain_codes(exact)
    by_label = {}
    for (_, _, label, _), e in zip(rows, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    got = sorted(codes.compress(df).collect())
    assert [tuple(r) for r in got] == sorted((i, c, e, by_label[label], digest) for (i, _, label, _), c, e in zip(rows, want_codes, errors, strict=True))


def test_nearest_entries_of_one_annulus():
    rng = np.random.default_rng(2)
    for book in (rng.integers(-3, 4, (16, 4)), np.zeros((5, 4), np.int64), rng.integers(-500, 500, (16, 4)), np.full((1, 4), 7)):
        xs = np.concatenate([rng.integers(-4, 5, (300, 4)), rng.integers(-600, 600, (300, 4)), book])
        index, least = codes.nearest(xs, book)
        every = ((xs[:, None] - book[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()
    assert [len(x) for x in codes.nearest(np.zeros((0, 4), np.int64), np.zeros((2, 4), np.int64))] == [0, 0]


def test_vector_codes_of_odd_rows(spark):
    kind = "vec_id long, embedding array<float>, label int"
    few = spark.createDataFrame([(2, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.0, 3.0], 1), (None, [], None), (None, [0.0] * 9, None)], kind)
    got = codes.compress(few).collect()
    assert len(got) == 4 and all(r.error == 0 for r in got) and len({r.code for r in got}) == 2
    assert codes.compress(few.limit(0)).count() == 0 and codes.compress(few.where("vec_id = 5")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    books, length = codes.train(few)
    assert length == 16 and codes.decode(next(r.code for r in got if r.vec_id == 2), books)[:4].tolist() == [1, 2, 3, 0]
    with pytest.raises(Exception, match="beyond"):
        codes.compress(spark.createDataFrame([(i, [1e30] * 8, 1) for i in range(20)], kind).union(few)).count()


def plain_ranks(docs, items):
    """docs: (row, doc_id, text); items: {item_id: texts}."""
    from math import floor, log

    pattern = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    split = lambda t: re.findall(pattern, lower(t))
    texts = [(i, split(t)) for i, t in docs]
    texts = [(i, ts) for i, ts in texts if ts]
    n_docs, n_terms = len(texts), sum(len(ts) for _, ts in texts)
    df = {}
    for _, ts in texts:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, said in items.items():
        want = {t for x in said for t in split(x)} & set(df)
        scores = []
        for i, ts in texts:
            m = 10 + 90 * len(ts) * n_docs // n_terms
            score = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * ts.count(t) // (1000 * ts.count(t) + 8 * m)) for t in want & set(ts))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:10])]
    return out


def test_ranked_search_query_and_its_sql(spark):
    assert same(queries.op13_ranked_search(spark, SF), queries.ORACLES["op13_ranked_search"], SF) > 0


@pytest.mark.parametrize("pairs", [200_000, 40])
def test_ranks_against_brute_force(spark, monkeypatch, pairs):
    monkeypatch.setattr(ranked, "PAIRS", pairs)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)] + ["É1", "naïve", "Z"]
    pick = lambda k: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=k))
    docs = [(i, pick(rng.randint(1, 60)).replace(" ", rng.choice([" ", ", ", "-\n"]))) for i in range(400)]
    docs += [(500 + i, docs[7][1]) for i in range(30)] + [(7, docs[7][1]), (None, docs[7][1]), (600, None), (601, ""), (602, "?!")]
    items = {i: [pick(rng.randint(1, 25))] for i in range(12)} | {20: [None], 21: ["unknown"], 22: ["w1 w2", "W3"], None: ["w5 w6 w5"]}
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, row int").repartition(5)
    q = spark.createDataFrame([(k, t, "x") for k, ts in items.items() for t in ts], "item_id long, text string, term string")
    got = ranked.rank(d, q).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_ranks(docs, items)))
    assert ranked.rank(d.limit(0), q).count() == 0 and ranked.rank(d, q.limit(0)).count() == 0


def test_terms_of_whole_texts():
    text = "Ab_c" + "é" * 10 + " x" * 5000
    assert ranked.terms(text) == {b"ab": 1, "céééééééééé".encode(): 1, b"x": 5000} and not ranked.terms(None)


def test_thresholds_are_the_highest_safe_ones():
    rng = np.random.default_rng(3)
    for _ in range(400):
        m = int(rng.integers(1, 7))
        most = rng.integers(1, 30, m)
        last = np.array([int(rng.integers(1, x + 1)) for x in most])
        t1 = int(rng.integers(0, most.sum() + 1))
        unmet = lambda t: sum(0 if b >= t else min(a, t - 1) for a, b in zip(most.tolist(), last.tolist(), strict=True))
        assert ranked.threshold(most, last, t1) == max((t for t in range(1, 40) if unmet(t) < t1), default=0)
