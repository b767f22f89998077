"""Search by trigram postings against the scan, through passes, and what a query reads."""

import random

import pytest

from spoolmill.operators import postings, search

ROW = "path string, title string, body string, project string, last_active_at long"


def ranks(spark, home, rows, q):
    want = [(r.path, round(r.score, 9)) for r in search.bm25(rows, q, 1000).collect()]
    assert [(r.path, round(r.score, 9)) for r in postings.search(spark, home, q, 1000).collect()] == want, q
    return want


def test_passes_give_the_ranks_of_a_scan_and_of_a_rebuild(spark, tmp_path):
    rng = random.Random(6)
    text = lambda: "".join(rng.choices(["ab", "ba", "aa", "Needle", "é", "端口被占用", " ", "\n", "x%_"], k=rng.randint(0, 40)))
    first = [(f"p{i}", text()[:20], text(), rng.choice([None, "proj", "needle"]), i) for i in range(120)]
    then = [(p, t, text(), None, 0) for p, t, *_ in first[::7]] + [("new", None, "Needleneedle", None, 1), ("new", None, "", None, 1)]
    gone = [("p1",), ("p8",), ("nowhere",)]
    home, again = str(tmp_path / "a"), str(tmp_path / "b")
    now = {p: (p, *r) for p, *r in first} | {p: (p, *r) for p, *r in then if r[1]}
    for (p,) in gone:
        now.pop(p, None)
    frame = lambda rows: spark.createDataFrame(rows, ROW)
    assert postings.search(spark, home, "needle").count() == 0
    postings.build(frame(first), home)
    ranks(spark, home, frame(first), "needle")
    postings.update(frame(then), home, frame([(p, None, None, None, 0) for (p,) in gone]).select("path"))
    postings.build(frame(list(now.values())), again)
    for q in ("needle", "aba", "aaaa", "端口被", "x%_", "ABAAB", "nothing here"):
        want = ranks(spark, home, frame(list(now.values())), q)
        assert want == ranks(spark, again, frame(list(now.values())), q) and (want or q in ("nothing here", "ABAAB"))
    live = lambda h: sorted(map(repr, spark.read.schema(postings.GRAMS).parquet(f"{h}/grams").join(postings.records(spark, h), ["path", "version"]).select("gram", "path", "part", "positions").collect()))
    assert live(home) == live(again)
    with pytest.raises(ValueError):
        postings.search(spark, home, " ab ")


def test_a_query_reads_a_small_share_of_the_index(spark, tmp_path):
    rng = random.Random(1)
    rows = spark.createDataFrame([(f"p{i}", "t", "".join(chr(rng.randint(97, 122)) for _ in range(300)) + (" needle" if i % 50 == 0 else ""), None, i) for i in range(400)], ROW)
    home = str(tmp_path / "i")
    postings.build(rows, home)
    read = postings.lists(spark, home, ["nee", "eed", "edl", "dle"])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [In(gram" in plan or "IsNotNull(gram)" in plan
    files = {r[0] for r in read.selectExpr("input_file_name()").distinct().collect()}
    assert 0 < len(files) <= 4 < len(spark.read.parquet(f"{home}/grams").inputFiles()) / 5
    assert [r.path for r in postings.search(spark, home, "needle").collect()] == sorted((f"p{i}" for i in range(0, 400, 50)), key=lambda p: p)


def test_postings_are_those_of_a_scan_and_need_no_shuffle(spark, tmp_path):
    texts = ["abcabcab", "ab", None, "", "x\x00\x00\x00y", "\U0001f600\U0001f600\U0001f600 \U0001f600a", "端口被占用端口被", "ÀÉÎàéî", "aaaa\naaaa"]
    rows = [(f"p{i}", texts[-i], t, texts[i - 3], 0) for i, t in enumerate(texts)] + [("p1", None, "gone", None, 0)]
    frame, home = spark.createDataFrame(rows, ROW), str(tmp_path / "p")
    assert not any(x in postings.postings(frame)._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "Sort", "Aggregate"))
    postings.build(frame, home)
    want = {}
    for path, *row in rows[:-1]:
        for part, text in zip(postings.COLUMNS, row[:3]):
            for i in range(len(text or "") - 2):
                want.setdefault((text.lower()[i : i + 3], path, part), []).append(i)
    read = spark.read.schema(postings.GRAMS).parquet(f"{home}/grams").where("part != ''").collect()
    assert {(r.gram, r.path, r.part): r.positions for r in read} == want and len(read) == len(want)
    assert {r.path: r["size"] for r in postings.records(spark, home).collect()} == {p: sum(max(len(t or "") - 2, 0) for t in row[:3]) for p, *row in rows[:-1]}
    for q in ("\U0001f600" * 3, "\U0001f600 \U0001f600", "端口被占", "aaa"):
        assert ranks(spark, home, spark.createDataFrame(rows[:-1], ROW), q), q
    postings.update(spark.createDataFrame([], ROW), home, spark.createDataFrame([("p0",)], "path string"))
    assert postings.records(spark, home).count() == len(texts) - 1


def test_sorting_of_trigrams_of_few_and_of_very_many_characters():
    rng = random.Random(4)
    for alphabet in ("ab", [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]):
        texts = ["".join(rng.choices(alphabet, k=rng.randint(3, 50))) for _ in range(200)] + ["".join(alphabet) * 2]
        points, at, text, new = postings._sorted(texts)
        whole, starts = "".join(texts), [sum(map(len, texts[:i])) for i in range(len(texts))]
        want = sorted((t[i : i + 3], k, starts[k] + i) for k, t in enumerate(texts) for i in range(len(t) - 2))
        assert [(whole[a : a + 3], k, a) for a, k in zip(at.tolist(), text.tolist())] == want
        assert new.tolist() == [i == 0 or want[i - 1][0] != w[0] for i, w in enumerate(want)] and len(points) == len(whole)
