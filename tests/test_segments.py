"""Segments and cleaning against a line-by-line version in Python, on random lines and on samples."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from spoolmill.functions import segments as S
from spoolmill.functions import text as T

BOX = "[\u2500-\u257f]"
WIDE = "[\u3000-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef]"


def fence(line):
    m = re.match(r"[ \t]*(`{3,}|~{3,})(.*)$", line)
    return len(m[1]) if m and not (m[1][0] == "`" and "`" in m[2]) else 0


def closes(line, n):
    m = re.match(r"[ \t]*(`{3,}|~{3,})[ \t]*$", line)
    return bool(m) and len(m[1]) >= n


def run(lines, i, test):
    j = i
    while j < len(lines) and test(lines[j]):
        j += 1
    return lines[i:j]


def pipe(x):
    return "|" in x and re.search(r"[^| ]", x.strip()) is not None


def sep(x):
    return "-" in x and re.fullmatch(r"[|:\- ]*", x.strip()) is not None


def count(chars, lines):
    return sum(x.count(c) for x in lines for c in chars)


def candidate(lines, i):
    if i + 1 < len(lines) and pipe(lines[i]) and sep(lines[i + 1]):
        return "table", len(run(lines, i, lambda x: pipe(x) or sep(x)))
    graph = run(lines, i, lambda x: re.match(r" *[*|/\\]", x))
    if any(re.match(r"[*|/\\_+ ]*[|/\\]", x) for x in graph):
        return "code", len(graph)
    indent = run(lines, i, lambda x: x.startswith(("\t", "    ")))
    if len(indent) >= 2:
        return "code", len(indent)
    sub = run(lines, i, lambda x: x.startswith(("\t", "  ")))
    ink = sum(len(re.sub("[ \t]", "", x)) for x in sub)
    if len(sub) >= 2 and count("{};=", sub) >= 2 and count("{}()[];:=<>&|!+*/%^~,\"'`", sub) / ink >= 0.1:
        return "code", len(sub)
    box = run(lines, i, lambda x: re.search(BOX, x))
    if box:
        border = [re.fullmatch(f"[ \t\u2500-\u257f]*{BOX}[ \t\u2500-\u257f]*", x) is not None for x in box]
        framed = all(re.fullmatch("[│┃║](.*[│┃║])?", x.strip()) for x in box)
        return "table" if framed or len(box) >= 2 and border[0] and border[-1] else "code", len(box)
    return None


def kinds(lines):
    out, i = [], 0
    while i < len(lines):
        if n := fence(lines[i]):
            j = next((j for j in range(i + 1, len(lines)) if closes(lines[j], n)), len(lines) - 1)
            out += ["code"] * (j + 1 - i)
            i = j + 1
            continue
        free = run(lines, i, lambda x: not fence(x))
        k = 0
        while k < len(free):
            kind, n = candidate(free, k) or ("prose", 1)
            out += [kind] * n
            k += n
        i += len(free)
    return out


def width(x):
    return len(x) + len(re.findall(WIDE, x))


def codey(x):
    x = x.strip(" \t")
    ink = len(re.sub("[ \t]", "", x))
    diff = re.match(r"@@|diff |--- |\+\+\+ |[-+][^ \t]", x)
    return bool(x) and (x[-1] in "\\{([,;:=<>&|+*/" or bool(diff) or count("{}()[];:=<>&|!+*/%^~\\`", [x]) / ink >= 0.3)


def opens(x):
    return re.match(r"[ \t]*(#|>|```|~~~|[-*+] |\d+[.)]( |$))", x) is not None


def fold(para):
    w = max(map(width, para))
    out, cur = [], para[0]
    for x in para[1:]:
        hyphen = cur.rstrip(" \t").endswith("-") and re.match(r"[ \t]*[a-z]", x)
        wrapped = w >= 24 and width(cur) >= w - 3 and re.match(f"[ \t]*(?:[A-Za-z0-9\"'(“‘（]|{WIDE})", x) and not codey(cur) and not codey(x)
        if opens(x) or not (hyphen or wrapped):
            out.append(cur)
            cur = x
            continue
        a, b = cur.rstrip(" \t"), x.lstrip(" \t")
        cur = a[:-1] + b if hyphen else a + b if re.search(WIDE + "$", a) and re.match(WIDE, b) else f"{a} {b}"
    return [*out, cur]


def clean(text):
    lines = re.sub("\r\n?", "\n", text).split("\n")
    out, para = [], []
    for x, kind in zip([*lines, ""], [*kinds(lines), "end"], strict=True):
        bare = re.sub("\x1b\\[[0-9;]*m", "", x)
        if kind == "prose":
            y = re.sub(BOX, "", bare)
            y = (y.lstrip(" \t") if re.match(f" *{BOX}", bare) else y).rstrip(" \t")
            if y.strip(" \t"):
                para.append(y)
                continue
            y = [y]
        elif kind == "code":
            y = [bare]
        elif kind == "table":
            y = re.sub(r"\|[ \t]*$", "", re.sub(r"^[ \t]*\|", "", re.sub(BOX, "", bare))).strip()
            y = [y] if y and not sep(bare) else []
        else:
            y = []
        if para:
            out += fold(para)
            para = []
        out += y
    return "\n".join(out)


PIECES = ["plain words here", "a line that is long enough to have been wrapped by", "then it goes on", "ends in a hy-", "phen ated", "", "  ", "    code();", "\tx = {1};", "  a = b; c", "  soft", "```", "```py", "~~~~", "| a | b |", "|---|--|", "* | abc", "|\\ x", "* item", "- item two", "1. one", "┌──┐", "│ x │", "└──┘", "├ tree", "汉字汉字汉字汉字汉字汉字汉字", "字继续", "# head", "> quote", "\x1b[31mred\x1b[0m text", "+added", "_ x", "trailing \\", "f(a, b)[1] = {2};", "│ open"]


def test_random_lines(spark):
    rng = random.Random(4)
    texts = ["\n".join(rng.choices(PIECES, k=rng.randint(1, 14))) for _ in range(1500)] + ["\n".join(PIECES * 30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(4)
    got = df.select("id", S.kinds(F.split("t", "\n")).alias("k"), S.clean(F.col("t")).alias("c"), S.segments(F.col("t")).alias("s")).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.id]
        assert r.k == kinds(t.split("\n")), t
        assert r.c == clean(t), t
        assert sum(x.n for x in r.s) == len(r.k) and all(a.kind != b.kind for a, b in zip(r.s, r.s[1:]))


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


SAMPLES = {
    "escapes, invisibles and a no-break space": ("\ufeff\x1b[1mnote\x1b[0m: two\u00a0words\u200b", "note: two words"),
    "code keeps all but escapes": ("say:\n```sh\nls\u00a0-l  \x1b[32mok\x1b[0m\u200b\n```", "say:\n```sh\nls\u00a0-l  ok\u200b\n```"),
    "a longer fence holds a shorter one": ("````md\n```\nx  \n```\n````\ny  ", "````md\n```\nx  \n```\n````\ny"),
    "closed box": ("┌───┬───┐\n│ k │ v │\n├───┼───┤\n│ a │ b │\n└───┴───┘", "k  v\na  b"),
    "framed columns": ("│ k  v │\n│ a  b │", "k  v\na  b"),
    "open art stays": ("├── src\n│   └── a.py\n└── b", "├── src\n│   └── a.py\n└── b"),
    "markdown table": ("| k | v |\n|---|---|\n| a | b |", "k | v\na | b"),
    "version graph": ("* 1a2b first\n|\\\n| * 3c second\n|/", "* 1a2b first\n|\\\n| * 3c second\n|/"),
    "indented code": ("so:\n    for x in y:\n        print(x)   \n", "so:\n    for x in y:\n        print(x)   \n"),
    "two-space code": ("  let a = {};\n  a.b = '─';", "  let a = {};\n  a.b = '─';"),
    "wrapped words": ("this paragraph had been wrapped by a narrow\nterminal and is now put into one line for its\nreader", "this paragraph had been wrapped by a narrow terminal and is now put into one line for its reader"),
    "wrapped wide text": ("这一段文字原来被终端折成了两行显示\n现在合成一行", "这一段文字原来被终端折成了两行显示现在合成一行"),
    "hyphens": ("a word that was hyphen-\nated", "a word that was hyphenated"),
    "lists and headings stay": ("# a heading that is long enough to wrap\n- one item that is long enough to wrap\n- two", "# a heading that is long enough to wrap\n- one item that is long enough to wrap\n- two"),
    "diffs stay": ("--- a/file/with/a/very/long/name.txt\n+++ b/file/with/a/very/long/name.txt\n+new", "--- a/file/with/a/very/long/name.txt\n+++ b/file/with/a/very/long/name.txt\n+new"),
    "continued commands stay": ("docker run --rm --name some-container \\\nimage", "docker run --rm --name some-container \\\nimage"),
    "line ends": ("a\r\nb\rc", "a\nb\nc"),
}


@pytest.mark.parametrize("name", SAMPLES)
def test_samples(spark, name):
    text, want = SAMPLES[name]
    assert one(spark, text, S.clean) == want


def test_options(spark):
    assert one(spark, None, S.clean) is None and one(spark, "", S.clean) == ""
    tidy = lambda t: S.clean(t, tidy_prose=True, reflow_wraps=False)
    assert one(spark, "  汉字\n\n \n　　再来\n  plain\n  - 项", tidy) == "汉字\n\n再来\n  plain\n  - 项"
    assert one(spark, "## **a** [b](c)\n```\n# x\n```", lambda t: S.clean(t, strip_markdown=True)) == "a b (c)\n# x"
    assert one(spark, "wrapped words that go on and on and\nend", lambda t: S.clean(t, reflow_wraps=False)) == "wrapped words that go on and on and\nend"


def test_time_is_linear_in_the_lines_of_a_paragraph(spark):
    line = "this is a line of words that had been wrapped by it"

    def seconds(n):
        df = spark.createDataFrame([("\n".join([line] * n),)], "t string").select(F.length(S.clean(F.col("t"))).alias("n"))
        start = time.perf_counter()
        assert df.first()["n"] == n * (len(line) + 1) - 1
        return time.perf_counter() - start

    seconds(10)
    few, many = seconds(5000), seconds(40000)
    assert many < 16 * few + 5 and many < 60


def test_cheap_checks_before_patterns_tell_the_same(spark):
    """Most lines are spared the patterns; where one of them may match, it is tried."""
    rng = random.Random(9)
    every = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x11000))]
    lines = ["", *every, *("a" + c + "b" for c in every[0x1FFF:0x3100]), *("".join(rng.choices(" \t*_`[]()!>#-+1.|a─é　", k=rng.randint(1, 14))) for _ in range(4000))]
    rows = spark.createDataFrame(list(enumerate(lines)), "n int, line string").select("line", S._marked(F.col("line")).alias("marked"), F.col("line").rlike(S.MARKED).alias("want"), S._boxed(F.col("line")).alias("boxed"), F.col("line").rlike(T.BOX).alias("box"), T.plain_line(F.col("line")).alias("plain")).collect()
    assert [r.line for r in rows if r.marked != r.want or r.boxed != r.box] == []

    def plain(x):
        x = re.sub(r"^([ \t]*> ?)+", "", x)
        x = re.sub(r"^[ \t]*#+ ", "", x) if re.search(r"^[ \t]*#+ ", x) else re.sub(r"^[ \t]*([-*+]|[0-9]+[.)]) +", "", x)
        for p, to in ((r"!\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[([^\]]*)\]\(([^)]*)\)", r"\1 (\2)"), (r"`([^`]*)`", r"\1"), (r"\*\*([^*]+)\*\*", r"\1"), (r"__([^_]+)__", r"\1"), (r"\*([^*]+)\*", r"\1"), (r"_([^_]+)_", r"\1")):
            x = re.sub(p, to, x)
        return x

    assert [(r.line, r.plain) for r in rows if r.plain != plain(r.line)] == []
