from pyspark.sql import functions as F

from spoolmill.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_escapes_and_noise(spark):
    assert one(spark, "\x1b[31mred\x1b[0m \x1b]0;title\x07end\x1b", T.strip_escapes) == "red end"
    assert one(spark, "﻿a b​\x01", T.strip_noise) == "a b"
    assert one(spark, "a\r\nb\rc", T.normalize_newlines) == "a\nb\nc"


def test_code_keeps_all_but_escapes(spark):
    assert one(spark, " x  \x1b[1m=\x1b[0m 1", T.strip_escapes) == " x  = 1"


def test_fences(spark):
    lines = "a\n````md\n```\nx\n```\n````\nb\n~~~\nopen"
    assert one(spark, lines, lambda t: T.fenced(F.split(t, "\n"))) == [False, True, True, True, True, True, False, True, True]


def test_tables_blanks_and_plain_text(spark):
    table = "| a | b |\n|---|---|\n| c | d |"
    assert one(spark, table, lambda t: T.clean_table_lines(F.split(t, "\n"))) == ["a | b", "c | d"]
    assert one(spark, "a\n\n \n\nb", T.collapse_blanks) == "a\n\nb"
    assert one(spark, "## **Hi** [x](y)", T.plain_line) == "Hi x (y)"


def test_names(spark):
    assert one(spark, "a/b:c  d\te\x07f", T.sanitize) == "a-b-c-d-e-f"
    assert one(spark, "///", T.sanitize) == "session"
    assert one(spark, "<command-name>x\n\n real title ", T.title) == "real title"
    assert one(spark, None, T.title) == "(untitled)"


def test_fence_query_reads_whole_documents(spark, tmp_path):
    from spoolmill.plans import registry

    texts = ["`a` opens\nx\n```\ny\n```", "x" * 50 + "\n~~~\ny", "```js\nopen\n\nto the end", "plain"]
    spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.code, r.other) for r in registry.QUERIES["fence_segments"](spark, str(tmp_path)).collect()}
    assert got == {0: (3, 2), 3: (2, 1), 6: (4, 0), 9: (0, 1)}


def test_plain_text_of_whole_documents(spark, tmp_path):
    from spoolmill.plans import registry

    text = "# **T**\n> - `a` [x](y)\n```py\n# **kept**\n``\n````js\n_e_\n~~~~\n*kept*\n```\n![i](u)\n~~~~ any ` mark\n**after**\n```a`b\n\n~~~\n__open__"
    want = "T\na x (y)\n# **kept**\n``\ne\n*kept*\n```\n![i](u)\nafter\nab\n\n__open__"
    assert one(spark, text, T.to_plain_text) == want
    assert one(spark, "```\n```", T.to_plain_text) == "" and one(spark, None, T.to_plain_text) is None
    spark.createDataFrame([(3, "x" * 60 + "\n## h\n" + "**y** " * 50)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert registry.QUERIES["plain_text"](spark, str(tmp_path)).first()["plain"] == "x" * 60 + "\nh\n" + "y " * 50 + "\ne"


def test_sanitize_query_keeps_the_full_id(spark, tmp_path):
    from spoolmill.plans import registry

    spark.createDataFrame([(1, "a" * 50 + "/1"), (2, "a" * 50 + "/2")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.id for r in registry.QUERIES["sanitize_session_id"](spark, str(tmp_path)).collect()}
    assert got == {1: "a" * 50 + "-1", 2: "a" * 50 + "-2"}
