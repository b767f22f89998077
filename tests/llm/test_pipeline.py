"""The pipeline's stages on odd rows, and run() against its stages one by one."""

import os
import random

import pytest

import corpus_pipeline
from spoolmill.llm import common, jaccard

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, row int, kept boolean"


def prose(seed, n=120):
    """Ordinary sentences, which the quality rules keep."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra", "si", "to") for b in ("ban", "der", "fil", "gon", "hus")]
    return " ".join(" ".join(rng.choices(words, k=12)).capitalize() + "." for _ in range(n // 12))


@pytest.fixture(scope="module")
def odd(spark):
    same = prose(1)
    rows = [(1, same, "en", "a1"), (1, same, "en", "a1"), (2, same, None, "a1"), (None, prose(2), "en", None), (None, prose(3), "en", "b7"), (4, None, "en", "a1"), (5, "", "de", "a1"), (6, " \n", "de", "a1")]
    rows += [(10 + i, prose(10 + i) + f" Mail a{i}@b.org.", "en", f"s{i % 3}") for i in range(12)] + [(40, prose(40, 12000), "en", "a1")]
    return spark.createDataFrame([(*r, 0, i, True) for i, r in enumerate(rows)], KIND).repartition(3).cache()


def test_each_stage_takes_odd_rows_and_empty_tables(spark, odd):
    columns = list(corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        rows = out.collect()
        assert out.columns == columns and rows, name
        none = stage(spark, odd.limit(0), SF)
        assert none.columns == columns and none.count() == 0, name
        texts = [r.text for r in rows]
        if name == "quality":
            assert {r.doc_id for r in rows} & {4, 5, 6} == set() and len(rows) > 12
        elif name == "jaccard":
            assert texts.count(prose(1)) == 1 and [r.doc_id for r in rows if r.text == prose(1)] == [1] and len(rows) == odd.count() - 2
            assert sum(not (t or "").strip() for t in texts) == 3
        elif name == "pii":
            assert len(rows) == odd.count() and texts.count(None) == 1 and sum("<EMAIL>" in (t or "") for t in texts) == 12 and not any("@" in (t or "") for t in texts)
            assert all(r.n_chars is None or r.n_chars == len(r.text) for r in rows)
        else:
            assert all(t.strip() for t in texts)
    packed = corpus_pipeline.pack_windows(spark, odd, SF)
    assert packed.count() >= odd.count() and packed.where("doc_id = 5").first()["doc_tokens"] == 1
    assert corpus_pipeline.pack_windows(spark, odd.limit(0), SF).count() == 0


def test_run_gives_what_its_stages_give_and_leaves_one_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    before = set(os.listdir(common.folder(spark)))
    got = corpus_pipeline.run(spark, SF)
    assert len(set(os.listdir(common.folder(spark))) - before) == 1
    key = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert sorted(map(repr, got.select(*key).collect())) == sorted(map(repr, docs.select(*key).collect()))


@pytest.mark.parametrize("copies", [700, 40])
def test_repeated_rows_of_large_and_small_groups_count_once_a_row(spark, copies):
    rng = random.Random(copies)
    base = prose(0, 300).split()
    texts = []
    for i in range(copies):  # each differs from the others in a few words
        words = list(base)
        words[rng.randrange(len(words))] = f"x{i}"
        texts.append((i, " ".join(words)))
    rows = [*texts, texts[5], *[(None, texts[6][1])] * 3]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows) and {r.n_links for r in got} == {len(rows) - 1} and {r.class_id for r in got} == {0}


def test_scratch_drops_what_is_not_kept(spark):
    here = lambda: len(os.listdir(common.folder(spark)))
    before = here()
    with common.scratch() as keep:
        with common.scratch() as inner:
            a = inner(common.cut(spark.range(3)))
            common.cut(spark.range(4))
        assert here() == before + 1 and a.count() == 3
        b = keep(common.cut(a.selectExpr("id + 1 AS id")))
    assert here() == before + 1 and b.count() == 3
    common.drop(b)
    assert here() == before
