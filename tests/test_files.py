import os

from pyspark.sql import functions as F

from spoolmill.sources import files

RECORD = "path string, state string, trashed_at long, tool string, session_id string, project string, started_at long, last_active_at long, starred boolean, messages array<struct<turn:int,speaker:string,role:string,text:string>>"
SAID = [(0, "user", "user", "what is\n\nthis"), (1, "codex", "assistant", "that")]


def records(spark, *rows):
    return spark.createDataFrame([(p, s, t, "codex", "s", None, 5, at, star, said) for p, s, t, at, star, said in rows], RECORD)


def outcomes(df):
    return sorted((r.path, r.state, r.outcome) for r in df.collect())


def test_records_come_back_from_files(spark, tmp_path):
    root = str(tmp_path / "a")
    r = records(spark, ("a.md", "live", None, 9, True, SAID), ("a.md", "trash", 77, 8, False, SAID), ("b c+%41.md", "live", None, 7, None, None), ("d.md", None, None, None, False, SAID[:1]))
    assert outcomes(files.save(r, root)) == [("a.md", "live", "written"), ("a.md", "trash", "written"), ("b c+%41.md", "live", "written"), ("d.md", "live", "written")]
    got = {(x.path, x.state): x for x in files.scan(spark, root).collect()}
    assert {x.status for x in got.values()} == {"ok"} and len(got) == 4
    a = got["a.md", "live"]
    assert (a.tool, a.session_id, a.project, a.started_at, a.last_active_at, a.starred, a.title, a.trashed_at) == ("codex", "s", None, 5, 9, True, "what is", None)
    assert [tuple(m) for m in a.messages] == SAID and got["a.md", "trash"].trashed_at == 77
    assert got["b c+%41.md", "live"].messages == [] and got["d.md", "live"].last_active_at == 0
    assert [x.path for x in files.load(spark, root).collect()] == ["a.md", "b c+%41.md", "d.md"]
    assert os.listdir(f"{root}/_parts") == []


def test_what_is_not_a_record(spark, tmp_path):
    root = tmp_path / "a"
    files.save(records(spark, ("a.md", "live", None, 9, True, SAID)), str(root))
    (root / "bad.md").write_bytes(b"---\n\xff\n")
    (root / "other.md").write_text("text")
    (root / "odd.md").write_text((root / "a.md").read_text().replace("tool: codex", "tool: vim"))
    (root / "early.md").write_text((root / "a.md").read_text().replace("---\n\n", "---\nhello\n"))
    (root / "notes.txt").write_text("text")
    (root / ".hidden.md").write_text("text")
    (root / "sub").mkdir()
    (root / "sub" / "deep.md").write_text("text")
    (root / "_parts" / "left").mkdir()
    (root / "_parts" / "left" / "half.md").write_text("---")
    (root / "_trash" / "old.md").write_text((root / "a.md").read_text())
    got = {(r.path, r.state): r.status for r in files.scan(spark, str(root)).collect()}
    assert got == {("a.md", "live"): "ok", ("bad.md", "live"): "undecodable", ("other.md", "live"): "malformed_frontmatter", ("odd.md", "live"): "unknown_tool", ("early.md", "live"): "malformed_body", ("old.md", "trash"): "ok"}
    arrived = files.scan(spark, str(root)).where("state = 'trash'").first().trashed_at
    assert arrived == int(os.stat(root / "_trash" / "old.md").st_mtime)


def test_saving_again_mirrors_and_names(spark, tmp_path):
    root = str(tmp_path / "a")
    rows = [("a.md", "live", None, 9, True, SAID), ("b.md", "live", None, 7, False, SAID)]
    files.save(records(spark, *rows), root)
    before = os.stat(f"{root}/a.md").st_mtime_ns
    again = records(spark, rows[0], ("b.md", "live", None, 8, False, SAID), ("b.md", "live", None, 7, True, SAID), ("../x.md", "live", None, 1, False, SAID), (None, "live", None, 1, False, SAID), ("x" * 300 + ".md", "live", None, 1, False, SAID))
    got = outcomes(files.save(again.withColumn("Path2", F.lit(1)), root).where("path IS NOT NULL"))
    assert got == [("../x.md", "live", "bad_name"), ("a.md", "live", "same"), ("b.md", "live", "written"), ("x" * 300 + ".md", "live", "bad_name")]
    assert os.stat(f"{root}/a.md").st_mtime_ns == before and sorted(os.listdir(tmp_path)) == ["a"]
    assert files.scan(spark, root).where("path = 'b.md'").first().last_active_at == 8
    left = outcomes(files.mirror(records(spark, ("a.md", "trash", 5, 9, True, SAID)), root))
    assert left == [("a.md", "live", "removed"), ("a.md", "trash", "written"), ("b.md", "live", "removed")]
    assert files.save(records(spark, rows[0]).limit(0), root).isEmpty()
    assert outcomes(files.discard(spark.createDataFrame([("z.md", "live"), ("../a", "live")], "path string, state string"), root)) == [("../a", "live", "missing"), ("z.md", "live", "missing")]


def test_a_failed_file_is_an_outcome(spark, tmp_path):
    root = tmp_path / "a"
    (root / "a.md").mkdir(parents=True)
    (root / "a.md" / "x").write_text("")
    got = outcomes(files.save(records(spark, ("a.md", "live", None, 9, True, SAID), ("b.md", "live", None, 9, True, SAID)), str(root)))
    assert got == [("a.md", "live", "failed"), ("b.md", "live", "written")] and os.listdir(root / "_parts") == []
