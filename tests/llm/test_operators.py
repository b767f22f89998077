import gzip
import hashlib
import itertools
import random
import re
import time
import zlib
from uuid import uuid4

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoolmill.llm import chat, jaccard, licenses, media, mixing, packing, pii, quality, queries, toxicity, urls

from ..compare import same

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "x " * 70), (4, "word " * 30000), (5, "Ünï 端口 \x00 \U0001d518"), (6, "Call +1 (842) 555-6187 or a@b.co, 4111 1111 1111 1111; 10.0.0.1")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "en", "src1", "extra") for r in ODD], "doc_id long, text string, lang string, source string, words string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert same(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF) > 0


#: Names that the operators use themselves, for what they add and inside.
CLASH = "licence _licence digest _t _c _l _h hit host path rule verdict _rest _end _lang _domain domain take epoch n_tokens found spans base votes _w quality kept _id id key row blank n words _row node m a b conv_id sid chain".split()


@pytest.mark.parametrize("empty", [False, True])
def test_clashing_names_and_empty_tables(spark, odd, empty):
    import public_tokenizers

    df = odd.select("doc_id", "text", "lang", "source", *[F.lit(f"old {c}").alias(c) for c in CLASH], F.lit("http://a.com/x").alias("url"))
    df = df.limit(0) if empty else df
    n = 0 if empty else len(ODD)
    rules, path = urls.rule_table(spark), public_tokenizers.path("word_bpe_49k.json")
    runs = {
        "pii": (pii.detect(df), {"spans"}), "redact": (pii.redact(df), set()), "urls": (urls.judge(df, rules), {"host", "path", "rule", "verdict"}), "licences": (licenses.scan(df, licenses.known(spark)), {"digest", "licence", "line_licences"}),
        "mixing": (mixing.select(df), {"domain", "n_tokens", "epoch", "take"}), "quality": (quality.judge(df), {*quality.SIGNALS, "base_failed", "votes", "quality", "kept"}), "keep_one": (jaccard.keep_one(df), set()),
    }
    for name, (out, added) in runs.items():
        assert len(set(out.columns)) == len(out.columns) and set(out.columns) == set(df.columns) | added, name
        rows = out.collect()
        assert all(r[c] == f"old {c}" for r in rows for c in CLASH if c not in added), name
        if name not in ("mixing", "keep_one"):
            assert len(rows) == n, name
    fixed = [toxicity.score(df, {"x": 1.0}, list(toxicity.START)), media.read_back(media.to_media(df)), jaccard.join(df)]
    assert [x.count() for x in fixed] == [n] * 3 and (packing.pack(df, path).count() == 0) == empty


def luhn(d):
    return sum(int(x) if i % 2 == 0 else int(x) * 2 - 9 * (int(x) > 4) for i, x in enumerate(reversed(d))) % 10 == 0


def spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, t or "") if ok(m[0])]


def test_personal_data_against_brute_force(spark, docs, odd):
    hard = ["a@b.c_d@e.f g@h.i.", "1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1", "4111-1111 1111-1111 " + "1 " * 5000, "+1((((((( +12345678 +1 2-3.4(5)6 789", "x" * 5000 + "@", "𝔘 a@b.co"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(hard)], "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text"), more):
        found = pii.detect(df).select("text", pii.listed(F.filter("spans", lambda x: x["base"])).alias("s")).collect()
        assert len(found) == df.count()
        for r in found:
            assert r.s == ",".join(spans(r.text))


def test_redaction(spark, odd):
    got = {r.doc_id: r.text for r in pii.redact(odd).collect() if r.doc_id in (1, 2, 6)}
    assert got[1] is None and got[2] == ""
    assert got[6] == "Call <PHONE> or <EMAIL>, <CARD>; <IP>"


def test_very_many_addresses_in_one_text(spark):
    text = " ".join(f"user{i}@mail{i % 7}.example.com" for i in range(20_000))
    df = spark.createDataFrame([(1, text + " Ünï"), (2, "𝔘" * 3000 + " a@b.co, +1 842 555 6187" * 3)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.detect(df).select("doc_id", F.size("spans").alias("n"), pii.listed(F.filter("spans", lambda x: x["base"])).alias("s")).collect()}
    assert got[1].n == 20_000 and got[1].s == ",".join(spans(text)) and got[2].s == ",".join(spans("𝔘" * 3000 + " a@b.co, +1 842 555 6187" * 3))
    red = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert red[1] == " ".join(["<EMAIL>"] * 20_000) + " Ünï" and red[2] == "𝔘" * 3000 + " <EMAIL>, <PHONE>" * 3


def test_further_candidates_stay_apart_from_base_spans(spark):
    text = "IBAN DE89 3704 0044 0532 0130 00, 123-45-6789, token = abcdefgh1234, x [at] y.org, 842-555-6187, +1 842-555-6187, Dr. Anna Berg"
    found = pii.find(spark.createDataFrame([(text,)], "text string")).first()["found"]
    got = {(pii.KINDS[x.kind], text[x.s : x.e]) for x in found if not x.base}
    want = {("iban", "DE89 3704 0044 0532 0130 00"), ("national_id", "123-45-6789"), ("secret", "token = abcdefgh1234"), ("email", "x [at] y.org"), ("phone", "842-555-6187"), ("name", "Dr. Anna Berg")}
    assert got == want
    for a in found:
        assert a.base or not any(b.base and b.s < a.e and a.s < b.e for b in found)


def counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, cover = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover |= {i + k for i in at for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_against_brute_force(spark, docs, odd):
    many = " ".join(f"w{i} w{i + 1} w{i + 2}" for i in range(200)) * 2
    more = spark.createDataFrame([(1, many), (2, "a b c a b c a"), (3, "x\ny\nx\n \n \nx"), (4, " lead trail ")], "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text"), more):
        for r in quality.judge(df).collect():
            assert tuple(r[c] for c in quality.SIGNALS) == counts(r.text), r.text
            assert not (r.kept and r.base_failed)


def test_quality_tells_junk_from_prose(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    judged = queries.op9_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("NOT base_failed").toPandas()
    assert ((judged.label == 1) & ~judged.kept).sum() <= 0.01 * len(judged)
    assert ((judged.label == 0) & judged.kept).sum() <= 0.2 * max(1, (judged.label == 0).sum())


def test_url_rules_nest(spark):
    rules = urls.rule_table(spark, [("a.com", "/", "block"), ("a.com", "/x", "allow"), ("a.com", "/x/y", "block"), ("com", "/x/y/z", "allow"), ("b.a.com", "/", "allow")])
    cases = [("http://a.com/q", "a.com/"), ("http://www.a.com/x1", "a.com/x"), ("http://A.COM/x/yy?x", "a.com/x/y"), ("http://a.com/w", "a.com/"), ("http://c.com/x/y/z", "com/x/y/z"), ("http://xa.com/", None), ("http://b.a.com/x/", "a.com/x"), (None, None), ("nothing", None), ("http://b.a.com/", "b.a.com/"), ("http://a.com/q", "a.com/")]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(cases)], "page_id long, url string")
    got = {r.page_id: r.rule for r in urls.judge(df, rules).collect()}
    for i, (u, want) in enumerate(cases):
        if u != "http://b.a.com/x/":
            assert got[i] == want, u
    assert urls.judge(df.limit(0), rules).count() == 0


def test_licences(spark):
    text = licenses.MIT.upper().replace("SOFTWARE", "Software")
    df = spark.createDataFrame([(1, "Copyright (c) 2020 A B\n" + text), (2, "see:\nlicenced under cc by-nc 4.0\nend"), (3, None), (4, "MIT")], "doc_id long, text string")
    got = {r.doc_id: (r.licence, [x.licence for x in r.line_licences]) for r in licenses.scan(df, licenses.known(spark)).collect()}
    assert got[1][0] == "MIT" and got[2] == (None, ["CC-BY-NC-4.0"]) and got[3] == (None, []) and got[4] == (None, [])


def test_toxicity_grammar_and_held_out_accuracy(spark, odd):
    g = toxicity.Grammar({"idiot": 2.0, "clown": 2.0})
    kinds = lambda t: [k for k, _ in g.clause(t)]
    assert kinds("idiot") == [] and kinds('"idiot"') == [] and kinds("idiot clown") == []
    assert kinds("you are an idiot") == ["aimed"] and kinds("the idiot") == ["plain"] and kinds("idiot you") == ["aimed"]
    assert kinds("not an idiot") == ["negated"] and kinds("she said the clown") == ["reported"] and kinds('the "idiot"') == ["reported"] and kinds("i will kill you") == ["aimed_threat"]
    assert g.features("idiotic clowns") == [0.0] * len(toxicity.KINDS)
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = queries.op4_toxicity(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted != got.toxic).mean() < 0.05
    words, weights = toxicity.train(odd.limit(0), labels.limit(0).withColumn("toxic", F.lit(1)))
    assert toxicity.score(odd, words, weights).count() == len(ODD)


def test_licences_at_any_width(spark):
    import textwrap

    whole = {a: b for a, b in licenses.KNOWN if len(b) > 300}
    rows = [(a, "Copyright (c) 2020 A B. All rights reserved.\r\n" + textwrap.fill(b, width)) for a, b in whole.items() for width in (*range(50, 121), 400)]
    got = licenses.scan(spark.createDataFrame(rows, "want string, text string"), licenses.known(spark)).where("want <=> licence").count()
    assert len(whole) == 7 and got == len(rows)


def _matches(symbols: list[str], reach: int) -> list[tuple[int, str]]:
    """What the composed transducers should write, by looking at each match's surroundings."""
    out, words = [], [i for i, s in enumerate(symbols) if s != "quote"]
    for at, i in enumerate(words):
        if symbols[i] not in ("insult", "threat") or all(symbols[j] == symbols[i] for j in words):
            continue
        around = lambda kind, a, b: any(symbols[j] == kind for j in words[max(a, 0) : b])
        said = "report" in symbols[:i] or symbols[:i].count("quote") % 2
        if around("negation", at - reach, at):
            out.append((i, "negated"))
        elif said:
            out.append((i, "reported"))
        elif around("target", at - reach, at + reach + 1):
            out.append((i, {"insult": "aimed", "threat": "aimed_threat"}[symbols[i]]))
        else:
            out.append((i, symbols[i]))
    return out


@pytest.mark.parametrize("reach", [1, 2, 3])
def test_composed_transducers_against_brute_force(reach):
    machine = toxicity.composed(reach)
    draw = random.Random(reach)
    alphabet = [*toxicity.WORDS, "quote"]
    short = [list(x) for n in range(4) for x in itertools.product(alphabet, repeat=n)]
    for symbols in short + [draw.choices(alphabet, [3, 3, 2, 2, 1, 1, 1], k=draw.randrange(4, 16)) for _ in range(3000)]:
        assert machine.paths(symbols) == [_matches(symbols, reach)], symbols


def test_very_many_clauses_in_one_text():
    g = toxicity.Grammar({"idiot": 1.0})
    begun = time.monotonic()
    assert g.features("an idiot, " * 20_000)[0] > 9 and g.features("an idiot. " * 20_000)[0] > 9
    assert time.monotonic() - begun < 20


def test_media_round_trip_and_carving(spark, odd):
    got = media.read_back(media.to_media(odd)).collect()
    assert len(got) == len(ODD)
    texts = {r[0]: r[1] or "" for r in ODD}
    for r in got:
        raw = texts[r.doc_id].encode()
        pay = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.true_type) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]), "wav")
    import gzip

    wav, gz = media.store(b"RIFF not a file" + b"\0" * 49), gzip.compress(b"x" * 100)
    blob = b"RIFFxxxxWAVE" + wav + b"BM" + gz + b"tail"
    assert media.sniff(blob) == [("wav", 12, 12 + len(wav)), ("gzip", 14 + len(wav), 14 + len(wav) + len(gz))]


def brute(rows, threshold=0.8):
    shingle = jaccard.Shingler()
    with np.errstate(over="ignore"):
        sets = [set(shingle(t).tolist()) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= threshold * len(a | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return sorted((rows[i][0], min(rows[j][0] for j in range(len(rows)) if root[j] == root[i]), links[i]) for i in range(len(rows)))


def test_near_duplicates_against_brute_force(spark, docs, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(1000 + k, " ".join([*base[: rng.integers(90, 120)], *[f"k{k}"] * int(rng.integers(0, 3))])) for k in range(60)]
    rows += [(r.doc_id, r.text) for r in docs.collect()] + [(2000, ""), (2001, None), (2002, "a b"), (2003, "A  b"), (2003, "A  b")]
    monkeypatch.setattr(jaccard, "SMALL", 8)  # so that nodes split and pivots are used
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(df).collect())
    want = brute(rows)
    assert sum(a == b for a, b in zip(got, want)) >= 0.99 * len(want), [x for x in zip(got, want) if x[0] != x[1]][:3]
    kept = jaccard.keep_one(df).collect()
    assert len(kept) == len({r[1] for r in want})


@pytest.mark.parametrize("doc_id", [None, 7])
def test_sets_of_one_id_fetch_only_their_own_texts(spark, monkeypatch, tmp_path, doc_id):
    exact = jaccard._linked

    def counted(*a):
        run = exact(*a)

        def seen(batches):
            for b in batches:
                (tmp_path / uuid4().hex).write_text(str(b.num_rows))
                yield b

        return lambda batches: run(seen(batches))

    monkeypatch.setattr(jaccard, "_linked", counted)
    rows = [(doc_id, " ".join([*(f"w{i}" for i in range(120)), f"k{k}"])) for k in range(40)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.class_id, r.n_links) for r in got] == [(doc_id, 39)] * 40
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 40


CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\<[x]"), (2, 0, "user", "hi"), (2, 1, "assistant", "b"), (2, 2, "user", None), (3, 0, None, "</s>[INST]"), (None, 0, "assistant", "n"), (4, 0, "user", "hi"), (5, 7, "user", "hi"), (5, 7, "user", "hi")]


@pytest.mark.parametrize("vocabulary", [None, "byte_bpe_50k.json"])
def test_chat_stream_is_depth_first_and_reversible(spark, vocabulary, monkeypatch):
    import public_tokenizers

    from spoolmill.llm import common

    monkeypatch.setattr(common, "HOT", 1)
    path = vocabulary and public_tokenizers.path(vocabulary)
    stream, chains, last = chat.format_tree(spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").repartition(3), path)
    nodes = stream.orderBy("offset").collect()
    assert len(nodes) == 7 and [n.offset for n in nodes] == list(np.cumsum([0, *[n.tokens for n in nodes[:-1]]]))
    by_id, about = {n.node: n for n in nodes}, {c.chain: c for c in chains.collect()}
    children = {}
    for n in nodes:
        children.setdefault(n.parent, []).append(n)
        above, at = set(), n
        while at.parent:
            at = by_id[at.parent]
            above |= set(range(at.offset, at.offset + at.tokens))
        c = about[n.chain]
        spans = [(a.offset, a.tokens) for a in c.attends] + [(c.offset, n.offset - c.offset)]
        assert above == {k for o, m in spans for k in range(o, o + m)} and n.position == len(above)

    def size(n):  # a subtree is one interval that begins with its root
        return n.tokens + sum(map(size, children.get(n.node, [])))

    for n in nodes:
        inside = [m.offset for m in children.get(n.node, [])]
        assert all(n.offset < o < n.offset + size(n) for o in inside)
    turns = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(stream, chains, last, path).collect()}
    hi = ("user", "hi")
    assert turns == {1: [hi, ("assistant", "a\\<[x]")], 2: [hi, ("assistant", "b"), ("user", "")], 3: [("", "</s>[INST]")], None: [("assistant", "n")], 4: [hi], 5: [hi, hi]}
    assert chat.format_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))[0].count() == 0


def test_a_conversation_of_very_many_turns(spark):
    rows = spark.range(5000).selectExpr("1 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id) AS text")
    rows = rows.unionByName(spark.range(3000).selectExpr("2", "id", "if(id % 2 = 0, 'user', 'assistant')", "concat('turn ', id)").toDF("conv_id", "turn", "role", "text"))
    stream, chains, last = chat.format_tree(rows)
    assert stream.count() == 5000 and chains.count() == 1  # the second is the beginning of the first
    got = {r.conv_id: r.n for r in chat.read_back(stream, chains, last).select("conv_id", F.size("turns").alias("n")).collect()}
    assert got == {1: 5000, 2: 3000}


def test_mixing_budgets_and_prefixes(spark, odd):
    leaves = spark.createDataFrame([("web", "en", "a1", 100), ("web", "de", "a1", 10), ("books", "en", "b9", 1000)], "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang): r.budget for r in mixing.budgets(leaves).collect()}
    assert got == {("web", "de"): 20, ("web", "en"): 200, ("books", "en"): 890}  # web is full: the rest goes to books
    taken = mixing.select(odd)
    assert taken.agg(F.sum("take")).first()[0] == odd.agg(F.sum(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")))).first()[0]
    assert mixing.select(odd.limit(0)).count() == 0


def test_packing_round_trip(spark, docs, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    for df in (docs, odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        ids = {r.doc_id: np.array(whole.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4") for r in df.collect()}
        fill, got = {}, packing.pack(df, path).collect()
        for r in got:
            assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(ids[r.doc_id]) == r.doc_tokens
            fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert sum(r.length for r in got) == sum(map(len, ids.values()))
        for pieces in fill.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= packing.WINDOW
    encode = packing.Encoder(path, remember=3)
    for t in ["İstanbul ΣΑΣ don't I'LL a\x1cb x y éa <|endoftext|>x", "ß Straße 12.5% 'S 日本語 𝔘 ﬁ", "", "\t"]:
        assert np.frombuffer(encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def sum_of_squares(sizes, window):
    """Placements by trying every choice: the level each piece goes to, with the windows open at the end."""
    open_, out = [], []
    for size in sizes:
        best = None
        for level in {0, *open_}:
            if level + size > window:
                continue
            after = list(open_)
            if level:
                after.remove(level)
            if level + size < window:
                after.append(level + size)
            cost = sum(after.count(x) ** 2 for x in set(after))
            if best is None or (cost, -level) < best[:2]:
                best = cost, -level, after
        out.append(-best[1])
        open_ = best[2]
    return out, sorted(open_)


@pytest.mark.parametrize("seed", range(6))
def test_packing_rule_against_brute_force(seed):
    window, rng = 12, np.random.default_rng(seed)
    sizes = rng.integers(1, window, 200).tolist()
    packer, at, done = packing.SumOfSquares(0, window), [], []
    for i, size in enumerate(sizes):
        before = packer.count.copy()
        done += packer.put(i, np.arange(size) + 70_000 * (i % 2))
        opened = np.flatnonzero(packer.count - before > 0)
        left = np.flatnonzero(before - packer.count > 0)
        at.append(int(left[0]) if len(left) else 0)
        assert len(opened) <= 1 and len(left) <= 1
    want, open_ = sum_of_squares(sizes, window)
    assert at == want and sorted(np.repeat(np.arange(window + 1), packer.count).tolist()) == open_
    done += packer.close()
    assert sum(len(d[2]) for d in done) == sum(sizes) and all(d[2].max() < 70_000 or i % 2 for d in done for i in [d[0]])


def test_pipeline_runs_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
        if name == "jaccard":
            assert docs.count() == docs.select("doc_id").distinct().count() < before
    assert corpus_pipeline.pack_windows(spark, docs, SF).count() > 0


def test_media_inside_others_are_carved(spark):
    gz = gzip.compress(b"x" * 100)
    inner = media.store(b"ab" + gz + b"tail")
    blob = b"junk" + media.store(b"RIFF no " + inner + b"GIF89a") + gz
    got = [tuple(r) for r in media.carve(spark.createDataFrame([(1, blob), (None, None), (3, b"")], "doc_id long, media binary")).orderBy("start").collect()]
    a, b, c, d = 4, 4 + 44 + 8, 4 + 44 + 8 + 44 + 2, len(blob) - len(gz)
    want = [("wav", a, d, 0), ("wav", b, b + len(inner), 1), ("gzip", c, c + len(gz), 2), ("gzip", d, len(blob), 0)]
    assert got == [(1, k, s, e, n, blob[s:e]) for k, s, e, n in want]
