import time

from pyspark.sql import functions as F

from spoolmill.operators import search, store
from spoolmill.sources import adapters, bridge

DAY = 86400
ROW = "path string, last_active_at long, starred boolean, state string, trashed_at long"


def archive(spark):
    now = 100 * DAY
    return now, spark.createDataFrame([("old", now - 9 * DAY, False, "live", None), ("star", now - 9 * DAY, True, "live", None), ("new", now - DAY, False, "live", None), ("gone", 0, False, "trash", now - 8 * DAY)], ROW)


def test_cleanup_expires_and_purges_but_not_the_same_row(spark):
    now, a = archive(spark)
    got = {r.path: (r.state, r.trashed_at) for r in store.cleanup(a, now, 7).collect()}
    assert got == {"old": ("trash", now), "star": ("live", None), "new": ("live", None)}
    kept = store.cleanup(a, now, None).collect()
    assert {r.path for r in kept if r.state == "live"} == {"old", "star", "new"}
    safe = store.cleanup(a, now, 7, protected=spark.createDataFrame([("old",)], "path string"))
    assert {r.path for r in safe.collect() if r.state == "live"} == {"old", "star", "new"}


def test_upsert_keeps_the_star(spark):
    _, a = archive(spark)
    new = a.where("path = 'star'").withColumn("starred", F.lit(False)).withColumn("last_active_at", F.lit(5).cast("long"))
    got = {r.path: r for r in store.upsert(a, new).collect()}
    assert len(got) == 4 and got["star"].starred and got["star"].last_active_at == 5


def test_upsert_leaves_the_trash_and_rows_without_a_time(spark):
    _, a = archive(spark)
    new = spark.createDataFrame([("gone", 5, False, "live", None), ("n", None, False, "live", None), ("n", None, True, "live", None), ("m", None, False, "live", None), ("m", 3, False, "live", None)], ROW)
    got = sorted((r.path, r.state, r.last_active_at, r.starred) for r in store.upsert(a, new).collect() if r.path in ("gone", "n", "m"))
    assert got == [("gone", "live", 5, False), ("gone", "trash", 0, False), ("m", "live", 3, False), ("n", "live", None, True)]


def test_search_short_long_and_literal(spark):
    rows = spark.createDataFrame([("p1", "t", "nginx 服务没有启动 50%_off", None, 1), ("p2", "postgres", "50 off", "proj", 2)], "path string, title string, body string, project string, last_active_at long")
    find = lambda q: [r.path for r in search.search(rows, q).collect()]
    assert find("服务没") == ["p1"] and find("服务") == ["p1"] and find("%_") == ["p1"] and find("POST") == ["p2"] and find("  ") == []


def test_snippets(spark):
    body = "İ" + "a" * 40 + "Needle" + "b" * 40
    df = spark.createDataFrame([(body,), ("short",)], "b string")
    got = [tuple(r) for r in df.select(search.snippet(F.col("b"), "needle"), search.ranked_snippet(F.col("b"), "needle")).collect()]
    assert got[0] == ("…" + "a" * 30 + "«Needle»" + "b" * 30 + "…", "…" + "a" * 8 + "«Needle»" + "b" * 8 + "…")
    assert got[1] == ("short", "short")


def test_nulls_stay_and_repeated_rows_do_not_double(spark):
    now, a = archive(spark)
    odd = a.unionByName(spark.createDataFrame([("x", 0, True, "trash", None), ("y", 0, True, None, None)], ROW))
    twice = spark.createDataFrame([("old",), ("old",)], "path string")
    kept = [r.path for r in store.cleanup(odd, now, 7, protected=twice).collect()]
    assert sorted(kept) == ["new", "old", "star", "x", "y"]
    two = a.where("path = 'star'").unionByName(a.where("path = 'star'").withColumn("last_active_at", F.lit(9).cast("long")))
    assert store.upsert(a, two).where("path = 'star'").count() == 1
    assert {tuple(r) for r in store.cleanup_lists(a, now, 7).collect()} == {("old", "trashed"), ("gone", "purged")}
    assert [r.path for r in store.load(a, "star").collect()] == ["star"] and store.remove(a, twice).count() == 3
    assert store.first_of_each(two, "path", "last_active_at").first()["last_active_at"] == 9


def test_moves_to_and_from_the_trash(spark):
    now, a = archive(spark)
    b = a.unionByName(spark.createDataFrame([("new", 0, False, "trash", 5), ("n.md", 0, False, "trash", 5), ("n.md", 1, False, "live", None)], ROW))
    got = {r.path: (r.state, r.trashed_at) for r in store.move_to(b, "n.md", "live", now, "ab12cd34").collect()}
    assert got["n-ab12cd34.md"] == ("live", None) and got["n.md"] == ("live", None)
    assert {r.path: r.trashed_at for r in store.move_to(a, "new", "trash", now, "z").collect()}["new"] == now
    try:
        store.move_to(a, "nowhere", "trash", now, "z")
        raise AssertionError
    except KeyError:
        pass


LINES = ['{"type":"user","sessionId":"s","cwd":"/","timestamp":"2024-01-01T00:00:00Z","message":{"content":"[1]"}}', "{broken", "null", "[1]", '{"type":5,"cwd":"/a/b/"}', '{"type":"assistant","message":{"content":[{"type":"tool_use","text":"no"}]}}', '{"type":"user","timestamp":"2024-01-01","message":{"content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}}', '{"type":"assistant","message":{"content":"x"}}', '{"type":"user","message":{"content":" \\n "}}']


def test_lenient_json(spark):
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(LINES)], "file string, line_no int, line string")
    got = [(r.line_no, r.role, r.text, r.ts) for r in adapters.messages(adapters.flat_events(df)).orderBy("line_no").collect()]
    assert got == [(0, "user", "[1]", 1704067200), (6, "user", "a\n\nb", None)]
    files = df.unionByName(spark.createDataFrame([("/r/e.jsonl", 0, "  "), ("/r/n.jsonl", 0, "{}")], df.schema))
    got = {r.file: (r.parse_status, r.session_id, r.project, r.started_at) for r in adapters.sessions(files, adapters.ADAPTERS["claude-code"]).collect()}
    assert got == {"f": ("ok", "s", "b", 1704067200), "/r/e.jsonl": ("empty", None, None, None), "/r/n.jsonl": ("no_messages", None, None, None)}


def test_wrapped_envelope(spark):
    lines = ['{"type":"session_meta","payload":{"id":7,"cwd":"/w/proj"}}', '{"item":{"type":"Message","role":"user","content":[{"type":"INPUT_TEXT","text":"q"}]}}', '{"type":"response_item","payload":{"type":"x","role":"assistant","content":"a"}}', '{"type":"message","role":"system","content":"no"}', '{"type":"message","role":"user","content":[{"type":"text","text":"t"},5]}', '{"item":{"role":"user","content":"untyped"}}']
    df = spark.createDataFrame([("/x/rollout-9.jsonl", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    r = adapters.sessions(df, adapters.ADAPTERS["codex"]).first()
    assert (r.session_id, r.project, r.started_at) == ("9", "proj", 0) and [(m.speaker, m.text) for m in r.messages] == [("user", "q"), ("codex", "a")]


def test_decoder_states(spark):
    good = "---\ntool: codex\nsession_id: s\nstarted_at: 2024-01-01T00:00:00Z\nlast_active_at: 2024-01-01T00:00:00Z\nstarred: no\nstarred: true\n---\n\n你：\nhi \x01\n\nUser：\n\nCodex：\nUser： inline\n\n"
    cases = {good: "ok", "": "malformed_frontmatter", "---\ntool: x\n": "malformed_frontmatter", good.replace("codex", "other"): "unknown_tool", good.replace("started_at", "begun"): "malformed_frontmatter", good.replace("你：\n", "text\n"): "malformed_body", good.replace("01T00", "01 00"): "malformed_frontmatter"}
    df = spark.createDataFrame([(k,) for k in cases], "md string")
    got = df.select("md", bridge.from_markdown(F.col("md")).alias("d")).collect()
    assert {r.md: r.d.status for r in got} == cases
    d = next(r.d for r in got if r.md == good)
    assert d.fields["starred"] == "true" and [(m.label, m.text) for m in d.messages] == [("User", "hi \x01"), ("User", ""), ("Codex", "User： inline")]


def test_decoder_is_linear_and_takes_the_last_of_a_key(spark):
    head = "---\ntool: codex\nsession_id: s\nstarted_at: 2024-01-01T00:00:00Z\nlast_active_at: 2024-01-01T00:00:00Z\nstarred: no\nb: 1\na: 1\nb: 2\n---\n\n"

    def took(lines):
        body = "User：\n" + "\n".join(f"line {i}" if i % 3 != 1 else "" for i in range(lines)) + "\n\n" + "Codex：\nx\n\n" * (lines // 3)
        df = spark.createDataFrame([(head + body,)], "md string")
        start = time.perf_counter()
        d = df.select(bridge.from_markdown(F.col("md")).alias("d")).first().d
        seconds = time.perf_counter() - start
        assert d.status == "ok" and len(d.messages) == 1 + lines // 3 and d.messages[0].text.count("\n") == lines - 1
        assert d.fields["b"] == "2" and d.fields["a"] == "1" and all(m.text == "x" for m in d.messages[1:])
        return seconds

    took(100)
    assert took(100_000) < 20


def test_decoder_of_null(spark):
    d = spark.createDataFrame([(None,)], "md string").select(bridge.from_markdown(F.col("md")).alias("d")).first().d
    assert d.status == "malformed_frontmatter" and not d.messages


def test_many_moves_at_once(spark):
    rows = [("a.md", 1, "live"), ("a.md", 2, "trash"), ("b.md", 3, "trash"), ("c.md", None, "live"), ("d.md", 4, "live"), ("e.md", 5, "live"), ("e.md", 6, "live"), ("f", 1, "live"), ("f", 0, "trash")]
    a = spark.createDataFrame([(p, t, False, s, 7 if s == "trash" else None) for p, t, s in rows], ROW)
    asked = spark.createDataFrame([(p,) for p in ("a.md", "a.md", "b.md", "c.md", "e.md", "f", "no.md", None)], "path string")
    after, errors = store.move(a, asked, "trash", 50)
    assert {tuple(r) for r in errors.collect()} == {("b.md", "there"), ("no.md", "missing"), (None, "missing")}
    got = sorted((r.path, r.last_active_at, r.state, r.trashed_at) for r in after.collect())
    assert len(got) == len(rows) and len({(g[0], g[2]) for g in got}) == len(rows)
    plain = {g for g in got if "-" not in g[0]}
    assert plain == {("a.md", 2, "trash", 7), ("b.md", 3, "trash", 7), ("c.md", None, "trash", 50), ("d.md", 4, "live", None), ("e.md", 6, "trash", 50), ("f", 0, "trash", 7)}
    other = {(g[0].split("-")[0], g[1], g[2], g[3], g[0].endswith(".md")) for g in got if "-" in g[0]}
    assert other == {("a", 1, "trash", 50, True), ("e", 5, "trash", 50, True), ("f", 1, "trash", 50, False)}
    back, none = store.move(after, after.select("path"), "live", 60)
    assert none.where("error <> 'there'").isEmpty() and back.where("state <> 'live' OR trashed_at IS NOT NULL").isEmpty() and back.count() == len(rows)
    assert back.select("path").distinct().count() == len(rows)
    empty, errors = store.move(a.limit(0), asked, "live", 1)
    assert empty.isEmpty() and errors.count() == 7


def test_expiry_beside_a_trashed_row_of_the_path(spark):
    now, a = archive(spark)
    b = a.unionByName(spark.createDataFrame([("old", 1, False, "trash", now - DAY)], ROW))
    got = [(r.path, r.trashed_at) for r in store.cleanup(b, now, 7).where("state = 'trash'").collect()]
    assert len(got) == 2 and ("old", now - DAY) in got and len({p for p, _ in got}) == 2
    assert {tuple(r) for r in store.cleanup_lists(b, now, 7).collect()} == {("old", "trashed"), ("gone", "purged")}


def test_beside(spark):
    a = spark.createDataFrame([("a", 3, False, "live", None), ("b", 3, False, "live", None), ("c", None, False, "live", None), ("t", 3, False, "trash", 1)], ROW)
    got = {p: [tuple(r) for r in store.beside(a, p).collect()] for p in "abct"}
    assert got == {"a": [("a", "b")], "b": [("a", "c")], "c": [("b", "c")], "t": []}
