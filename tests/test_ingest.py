import json
import os

import pytest
from pyspark.sql import functions as F

from spoolmill.streaming import ingest, log

DAY = 86400


def put(path, *texts, session="s", mtime=1000, mode="w", day=1):
    rows = [{"type": "user", "sessionId": session, "timestamp": f"2024-01-0{day}T00:00:00Z", "message": {"content": t}} for t in texts]
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, mode) as f:
        f.write("".join(json.dumps(r) + "\n" for r in rows))
    os.utime(path, (mtime, mtime))


def said(spark, home):
    return {r.session_id: [m.text for m in r.messages] for r in ingest.archive(spark, home).collect()}


def outcomes(spark, home):
    return {r.path.rpartition("/")[2]: (r.outcome, r.attempts) for r in ingest.manifest(spark, home).collect()}


def test_passes_parse_what_changed_and_retry_after_failure(spark, tmp_path, monkeypatch):
    top, home = tmp_path / "in", str(tmp_path / "home")
    root, roots = top / "p", {"claude-code": str(tmp_path / "in"), "codex": str(tmp_path / "other")}
    (tmp_path / "other" / "x").mkdir(parents=True)
    put(top / "top.jsonl", "no", session="top")
    put(root / "q" / "deep.jsonl", "no", session="deep")
    put(root / "a[1] b.jsonl", "one", session="a")
    put(root / "b.jsonl", "two", session="b")
    put(root / "new.jsonl", "early", session="new", mtime=5000)
    for name, content in (("none", b"{broken\n"), ("bytes", b"\xff\xfe\n"), ("blank", b" \n")):
        (root / f"{name}.jsonl").write_bytes(content)
        os.utime(root / f"{name}.jsonl", (1000, 1000))
    wrapped = tmp_path / "other" / "x" / "rollout-7.jsonl"
    wrapped.write_text('{"item":{"type":"message","role":"user","content":"wrapped"}}\n')
    os.utime(wrapped, (1000, 1000))
    assert said(spark, home) == {}
    assert ingest.sync(spark, roots, home, now=5000.1) == 1
    assert said(spark, home) == {"a": ["one"], "b": ["two"], "7": ["wrapped"]}
    assert outcomes(spark, home) == {"a[1] b.jsonl": ("ok", 0), "b.jsonl": ("ok", 0), "none.jsonl": ("no_messages", 0), "bytes.jsonl": ("undecodable", 0), "blank.jsonl": ("empty", 0), "rollout-7.jsonl": ("ok", 0)}
    assert ingest.sync(spark, roots, home, now=5000.1) == 1
    # a pass that fails before its commit leaves no trace and is done again
    put(root / "a[1] b.jsonl", "more", session="a", mtime=2000, mode="a")
    with monkeypatch.context() as m:
        m.setattr(ingest.log, "commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest.sync(spark, roots, home, now=6000)
    assert said(spark, home)["a"] == ["one"] and log.commits(spark, home) == [1]
    old = ingest.archive(spark, home)
    # a file that can't be read fails alone and is planned again
    lost = ingest.contents
    with monkeypatch.context() as m:
        m.setattr(ingest, "contents", lambda *a: lost(*a).where("NOT path LIKE '%new.jsonl'"))
        assert ingest.sync(spark, roots, home, now=6000) == 2
    assert said(spark, home) == {"a": ["one", "more"], "b": ["two"], "7": ["wrapped"]} and outcomes(spark, home)["new.jsonl"] == ("failed", 1)
    one, two = log.read(spark, home, 1).buckets, log.read(spark, home, 2).buckets
    assert sum(x != y for x, y in zip(one, two, strict=True)) == 1 and len(old.collect()) == 3  # only a's bucket is written; readers of the version before go on
    assert ingest.sync(spark, roots, home, now=6000) == 3 and said(spark, home)["new"] == ["early"] and outcomes(spark, home)["new.jsonl"] == ("ok", 0)
    # the archive outlives its sources, the manifest does not; tools that are off are pruned but not read
    (root / "b.jsonl").unlink()
    wrapped.unlink()
    put(root / "late.jsonl", "later", session="late")
    assert ingest.sync(spark, roots, home, now=6000, enabled=("codex",)) == 4
    assert set(outcomes(spark, home)) == {"a[1] b.jsonl", "new.jsonl", "none.jsonl", "bytes.jsonl", "blank.jsonl"} and len(said(spark, home)) == 4
    held = {x for x in log.read(spark, home).buckets if x}
    assert log.vacuum(spark, home, keep=1, grace=-1) and said(spark, home)["a"] == ["one", "more"]
    assert {p.name for p in (tmp_path / "home" / "archive").iterdir()} == held


def test_oversize_files_are_left_until_they_shrink(spark, tmp_path, monkeypatch):
    home, roots = str(tmp_path / "home"), {"claude-code": str(tmp_path / "in")}
    put(tmp_path / "in" / "p" / "a.jsonl", "x" * 3000, session="a")
    plan = ingest.store.plan_sync
    monkeypatch.setattr(ingest.store, "plan_sync", lambda *a, **k: plan(*a, **k, limit=2000))
    assert ingest.sync(spark, roots, home) == 1 and outcomes(spark, home) == {"a.jsonl": ("oversize", 0)} and said(spark, home) == {}
    assert ingest.sync(spark, roots, home) == 1
    put(tmp_path / "in" / "p" / "a.jsonl", "x", session="a")
    assert ingest.sync(spark, roots, home) == 2 and said(spark, home) == {"a": ["x"]}


def test_a_retention_pass_between_a_plan_and_its_commit_loses_neither(spark, tmp_path, monkeypatch):
    home, roots = str(tmp_path / "home"), {"claude-code": str(tmp_path / "in")}
    for i in range(6):
        put(tmp_path / "in" / "p" / f"{i}.jsonl", "old", session=f"s{i}")
    assert ingest.sync(spark, roots, home) == 1
    put(tmp_path / "in" / "p" / "n.jsonl", "new", session="n", day=9)
    now, real, calls = 1704067200 + 10 * DAY, log.commit, []

    def late(spark_, home_, commit):
        if not calls:
            calls.append(1)
            assert ingest.retain(spark, home, 5, now=now) == 2
        return real(spark_, home_, commit)

    with monkeypatch.context() as m:
        m.setattr(ingest.log, "commit", late)
        assert ingest.sync(spark, roots, home) == 3
    got = {r.session_id: r.state for r in ingest.archive(spark, home).collect()}
    assert got == {f"s{i}": "trash" for i in range(6)} | {"n": "live"}
    # a synced path that is in the trash keeps both rows; then the grace ends
    put(tmp_path / "in" / "p" / "0.jsonl", "old", "again", session="s0", mtime=3000)
    assert ingest.sync(spark, roots, home) == 4
    assert sorted(r.state for r in ingest.archive(spark, home).where("session_id = 's0'").collect()) == ["live", "trash"]
    ingest.retaining(spark, home, str(tmp_path / "c"), None, once=True).awaitTermination(60)
    assert sorted(r.session_id for r in ingest.archive(spark, home).collect()) == ["n", "s0"] and ingest.retain(spark, home, None) == 5


def test_a_tick_runs_a_pass(spark, tmp_path):
    home = str(tmp_path / "home")
    put(tmp_path / "in" / "p" / "a.jsonl", "one", session="a")
    ingest.ingest(spark, {"claude-code": str(tmp_path / "in")}, home, str(tmp_path / "checkpoint"), once=True).awaitTermination(60)
    assert said(spark, home) == {"a": ["one"]}


def test_contents_are_bounded_before_files_are_opened(spark, tmp_path):
    put(tmp_path / "a.jsonl", "one")
    put(tmp_path / "b.jsonl", "two", mtime=9000)
    plan = ingest.listing(spark, str(tmp_path)).where(F.col("path").endswith("b.jsonl"))
    found = ingest.contents(spark, str(tmp_path), "*.jsonl", plan)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(modificationTime" in text and "LessThanOrEqual(length" in text and [r.path.rpartition("/")[2] for r in found.collect()] == ["b.jsonl"]


def test_listing_by_depth_without_hidden_files(spark, tmp_path):
    for name in ("a.jsonl", "p/b.jsonl", "p/.h.jsonl", ".q/c.jsonl", "p/q/d.jsonl", "p/subagents/e.jsonl", "p/f.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}")
    names = lambda depth: sorted(r.path.rpartition("/")[2] for r in ingest.listing(spark, str(tmp_path), depth=depth).collect())
    assert names(None) == ["a.jsonl", "b.jsonl", "d.jsonl"] and names(2) == ["b.jsonl"]


def test_late_lines_change_bounds_and_title(spark, tmp_path):
    root, home = tmp_path / "in" / "p", str(tmp_path / "home")
    roots = {"claude-code": str(tmp_path / "in")}

    def row():
        ingest.sync(spark, roots, home, now=9000)
        r = ingest.archive(spark, home).collect()
        assert len(r) == 1
        return r[0].title, (r[0].started_at - 1704067200) // DAY, (r[0].last_active_at - 1704067200) // DAY, [m.text for m in r[0].messages]

    put(root / "a.jsonl", "one", day=2)
    assert row() == ("one", 1, 1, ["one"])
    put(root / "a.jsonl", "two", day=4, mtime=2000, mode="a")
    assert row() == ("one", 1, 3, ["one", "two"])
    put(root / "a.jsonl", "zero", day=2, mtime=3000)
    put(root / "a.jsonl", "three", day=3, mtime=3000, mode="a")
    assert row() == ("zero", 1, 2, ["zero", "three"])
