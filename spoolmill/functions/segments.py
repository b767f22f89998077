"""Code, prose and tables in a text, and the cleaning that treats each in its way.

A text's lines stay in one array: every line gets its predicates; a walk from the end gives each line the
kind and length of the run that would begin there; a walk from the front takes runs greedily. Inside
code only escape sequences go. Tables lose their borders, prose loses noise and hard wraps.

Time is linear in a text's length. Lines that show none of the marks that code and tables have (most do) take one
pattern only. Wrapped lines are joined by a fold over summaries: what the line joined so far has of width, ink, symbols, its
first and last characters. A summary and the next line's make the joined line's; the text itself is put together once.

Null texts stay null. Rows are independent; nothing is shuffled. Lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .arrays import going, let, walk

_TRIM = "[\\p{Zs}\\t]"
#: Characters of code (fixed values): strong ones; those that make indented lines code; those that keep prose apart.
STRONG = "{};="
CODE = "{}()\\[\\];:=<>&|!+*/%^~,\"'`"
DENSE = "{}()\\[\\];:=<>&|!+*/%^~\\\\`"
#: Wide characters (fixed values), and those of them that are letters.
WIDE = "\\x{3000}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{FF00}-\\x{FFEF}"
CJK = "\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}"
#: Line shapes: art of version graphs, its connectors, indents, pure borders, rows between vertical borders.
GRAPH, CONNECTED = "^ *[*|/\\\\]", "^[*|/\\\\_+ ]*[|/\\\\]"
INDENT, SUBINDENT = "^(\\t| {4})", "^(\\t| {2})"
BORDER = f"^[ \\t]*{T.BOX}[ \\t\\x{{2500}}-\\x{{257F}}]*$"
FRAMED = f"^{_TRIM}*[│┃║](.*[│┃║])?{_TRIM}*$"
#: What a line shows if any of the shapes of code or tables may fit it.
MARKED = "^[\\p{Zs}\\t*|/\\\\_+:\\-]|[|\\x{2500}-\\x{257F}]"
#: The first characters of :data:`MARKED`, all blanks among them.
FIRST = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\t*|/\\_+:-"
#: Lines that open a block of their own, whatever comes before.
OPENS = "^[ \\t]*(?:#|>|```|~~~|[-*+] |\\p{N}+[.)](?: |$))"
CONTINUES = f"^[ \\t]*[A-Za-z0-9\"'(“‘（{WIDE}]"
MIN_WRAP, WRAP_SLACK = 24, 3


def _many(line: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(line, f"[^{chars}]", ""))


def _ink(line: Column) -> Column:
    return F.length(F.regexp_replace(line, "[ \\t]", ""))


def _boxed(line: Column) -> Column:
    """Whether ``line`` has a box character; those of ASCII alone need no pattern."""
    return (F.octet_length(line) > F.length(line)) & line.rlike(T.BOX)


def _marked(line: Column) -> Column:
    """What :data:`MARKED` matches, for most lines without a pattern."""
    return ((line != "") & (F.instr(F.lit(FIRST), F.substring(line, 1, 1)) > 0)) | line.contains("|") | _boxed(line)


def _separator(line: Column) -> Column:
    return line.contains("-") & line.rlike(f"^{_TRIM}*[|:\\- ]*{_TRIM}*$")


_RUNS = "struct<sep:boolean,pipe:int,graph:int,joined:boolean,indent:int,sub:int,strong:int,code:int,ink:int,box:int,borders:int,closed:boolean,framed:boolean>"
_RUN = "struct<kind:string,n:int>"


#: A line that matters for kinds: its place, the kind and length of the run that begins there; 0 is prose.
_ITEM = "struct<i:int,kind:string,n:int>"


def _runs(items: Column) -> Column:
    """For each of ``items`` (i, fence, line), lines that are marked or fenced, an :data:`_ITEM`."""

    def look(z: Column) -> Column:
        x = z["line"]
        sub = x.rlike(SUBINDENT)
        some = lambda c: F.when(sub, c).otherwise(0)
        full = F.struct(
            T.is_pipe_row(x).alias("pipe"), _separator(x).alias("sep"), x.rlike(GRAPH).alias("graph"), x.rlike(CONNECTED).alias("joined"), x.rlike(INDENT).alias("indent"), sub.alias("sub"),
            some(_many(x, STRONG)).alias("strong"), some(_many(x, CODE)).alias("code"), some(_ink(x)).alias("ink"), x.rlike(T.BOX).alias("box"), x.rlike(BORDER).alias("border"), x.rlike(FRAMED).alias("framed"),
        )
        return F.struct(z["i"].alias("i"), F.when(~z["fence"], full).alias("y"))

    def step(before: Column, z: Column) -> Column:
        y = z["y"]
        # a line without marks, or a fence, between two lines ends all runs
        near = before["i"] == z["i"] + 1

        def found(s: Column) -> Column:
            def run(name: str, on: Column) -> Column:
                return F.when(on, s[name] + 1).otherwise(0)

            def total(name: str, on: Column) -> Column:
                return F.when(on, s[name] + y[name]).otherwise(0)

            box = y["box"]
            new = F.struct(
                y["sep"].alias("sep"), run("pipe", y["pipe"] | y["sep"]).alias("pipe"), run("graph", y["graph"]).alias("graph"), (y["graph"] & (y["joined"] | s["joined"])).alias("joined"), run("indent", y["indent"]).alias("indent"), run("sub", y["sub"]).alias("sub"),
                total("strong", y["sub"]).alias("strong"), total("code", y["sub"]).alias("code"), total("ink", y["sub"]).alias("ink"), run("box", y["box"]).alias("box"), F.when(box, s["borders"] + y["border"].cast("int")).otherwise(0).alias("borders"),
                (box & F.when(s["box"] == 0, y["border"]).otherwise(s["closed"])).alias("closed"), (box & y["framed"] & ((s["box"] == 0) | s["framed"])).alias("framed"),
            )

            def kind(r: Column) -> Column:
                drawn = ((r["box"] >= 2) & (r["borders"] >= 2) & y["border"] & r["closed"]) | r["framed"]
                dense = (r["sub"] >= 2) & (r["strong"] >= 2) & (10 * r["code"] >= r["ink"])
                said = (
                    F.when(y["pipe"] & s["sep"], F.struct(F.lit("table").alias("kind"), r["pipe"].alias("n")))
                    .when(r["joined"], F.struct(F.lit("code").alias("kind"), r["graph"].alias("n")))
                    .when(r["indent"] >= 2, F.struct(F.lit("code").alias("kind"), r["indent"].alias("n")))
                    .when(dense, F.struct(F.lit("code").alias("kind"), r["sub"].alias("n")))
                    .when(r["box"] > 0, F.struct(F.when(drawn, "table").otherwise("code").alias("kind"), r["box"].alias("n")))
                    .otherwise(F.struct(F.lit("prose").alias("kind"), F.lit(0).alias("n")))
                )
                item = let(said, lambda k: F.struct(z["i"].alias("i"), k["kind"].alias("kind"), k["n"].alias("n")))
                return going(F.struct(z["i"].alias("i"), r.alias("r")), item.cast(_ITEM))

            return let(new.cast(_RUNS), kind)

        fence = going(F.struct(F.lit(-1).alias("i"), none.alias("r")), F.struct(z["i"], F.lit("code"), F.lit(1)).cast(_ITEM))
        return F.when(y.isNull(), fence).otherwise(let(F.when(near, before["r"]).otherwise(none), found))

    none = F.struct(*[F.lit(x) for x in (False, 0, 0, False, 0, 0, 0, 0, 0, 0, 0, False, False)]).cast(_RUNS)
    return F.reverse(walk(F.reverse(F.transform(items, look)), F.struct(F.lit(-1), none), step, f"struct<i:int,r:{_RUNS}>", _ITEM)["out"])


def kinds(lines: Column) -> Column:
    """``code``, ``table`` or ``prose`` for each line."""

    def take(s: Column, z: Column) -> Column:
        """Runs in order, each from where the one before ended, with the prose between them."""
        gap = F.when(z["i"] > s["end"], F.array(F.struct(F.lit("prose"), z["i"] - s["end"]).cast(_RUN))).otherwise(F.array().cast(f"array<{_RUN}>"))
        runs = F.concat(gap, F.array(F.struct(z["kind"], z["n"]).cast(_RUN)))
        nothing = F.struct(F.struct(s["end"].alias("end")).alias("s"), F.array().cast(f"array<{_RUN}>").alias("out"))
        return F.when((z["n"] == 0) | (z["i"] < s["end"]), nothing).otherwise(F.struct(F.struct((z["i"] + z["n"]).alias("end")).alias("s"), runs.alias("out")))

    def whole(fenced: Column) -> Column:
        each = F.transform(lines, lambda x, i: F.when(F.get(fenced, i) | _marked(x), F.struct(i.alias("i"), F.get(fenced, i).alias("fence"), x.alias("line"))))
        marked = F.filter(each, lambda z: z.isNotNull())
        got = walk(_runs(marked), F.struct(F.lit(0)), take, "struct<end:int>", _RUN)
        expand = lambda g: F.flatten(F.transform(F.concat(g["out"], F.array(F.struct(F.lit("prose"), F.size(lines) - g["s"]["end"]).cast(_RUN))), lambda r: F.array_repeat(r["kind"], r["n"])))
        return let(got, expand)

    return let(T.fenced(lines), whole)


def segments(t: Column) -> Column:
    """Adjacent lines of one kind: an array of (kind, n), in order."""

    def step(s: Column, k: Column) -> Column:
        same = s["kind"].eqNullSafe(k)
        said = F.when(same | s["kind"].isNull(), F.array().cast(f"array<{_RUN}>")).otherwise(F.array(s))
        return F.struct(F.struct(k.alias("kind"), F.when(same, s["n"] + 1).otherwise(1).alias("n")).alias("s"), said.alias("out"))

    def whole(lines: Column) -> Column:
        got = walk(kinds(lines), F.struct(F.lit(None).cast("string"), F.lit(0)), step, _RUN, _RUN)
        return F.when(lines.isNotNull(), let(got, lambda g: F.concat(g["out"], F.array(g["s"]))))

    return let(F.split(T.normalize_newlines(t), "\n"), whole)


def _tidy(items: Column) -> Column:
    """Lose one to four leading blanks of CJK prose, and blank lines after the first of a run."""

    def line(y: Column) -> Column:
        body = F.regexp_replace(y["text"], "^[ \\x{3000}]+", "")
        dense = 10 * _many(body, DENSE) >= F.length(F.regexp_replace(body, "[ \\t\\x{3000}]", ""))
        pad = F.length(y["text"]) - F.length(body)
        led = F.instr(F.lit(" \u3000"), F.substring(y["text"], 1, 1)) > 0
        hit = (y["kind"] == "prose") & led & (y["text"] != "") & pad.between(1, 4) & (body != "") & ~body.rlike(OPENS.replace("[ \\t]*", "")) & body.rlike(f"[{CJK}]") & ~dense
        blank = (y["kind"] == "prose") & (F.btrim(y["text"], F.lit(" \t")) == "")
        return F.struct(y["kind"].alias("kind"), F.when(blank, "").when(hit, body).otherwise(y["text"]).alias("text"), blank.alias("blank"))

    def keep(lines: Column) -> Column:
        return F.filter(lines, lambda y, i: ~(y["blank"] & F.when(i > 0, F.get(lines, i - 1)["blank"]).otherwise(False)))

    return let(F.transform(items, line), keep)


#: A line of a paragraph: width and blanks at either end; characters that aren't blank, and dense ones; the start without
#: blanks and the length of all between the blanks; whether it is code; what its last characters are, and its first.
_LINE = "struct<w:int,lead:int,trail:int,ink:int,dense:int,head:string,n:int,coded:boolean,hyphen:boolean,ends:boolean,wide:boolean,opens:boolean,goes:boolean,lower:boolean,first:boolean>"
#: The same of lines that are joined so far, as much as the next seam needs.
_JOINED = "struct<w:int,trail:int,ink:int,dense:int,head:string,n:int,coded:boolean,hyphen:boolean,wide:boolean>"
#: As many characters as tell a diff's line.
_HEAD = 5
#: Last characters of lines that go on as code (fixed values).
ENDS = "{([,;:=<>&|+*/\\"


def _coded(ends: Column, head: Column, dense: Column, ink: Column) -> Column:
    return ends | ((F.instr(F.lit("@d+-"), F.substring(head, 1, 1)) > 0) & head.rlike(T.DIFF)) | (10 * dense >= 3 * ink)


def _line(x: Column, wide: Column) -> Column:
    """The summary (:data:`_LINE`) of one line that isn't blank; ``wide`` says whether its text has wide characters."""

    wide = wide & (F.octet_length(x) > F.length(x))

    def of(bare: Column) -> Column:
        lead = F.length(x) - F.length(F.ltrim(x, F.lit(" \t")))
        ink = F.length(F.replace(F.replace(bare, F.lit(" "), F.lit("")), F.lit("\t"), F.lit("")))
        dense = F.when(bare.rlike(f"[{DENSE}]"), _many(bare, DENSE)).otherwise(0)
        one = F.substring(bare, 1, 1)
        lower = one.between("a", "z")
        letter = lower | one.between("A", "Z")  # most lines begin with one, and then need no pattern

        def parts(p: Column) -> Column:
            return F.struct(
                p["w"].alias("w"), p["lead"].alias("lead"), (F.length(x) - p["lead"] - F.length(bare)).alias("trail"), p["ink"].alias("ink"), p["dense"].alias("dense"), p["head"].alias("head"), F.length(bare).alias("n"), _coded(p["ends"], p["head"], p["dense"], p["ink"]).alias("coded"),
                F.endswith(bare, F.lit("-")).alias("hyphen"), p["ends"].alias("ends"), (wide & bare.rlike(f"[{WIDE}]$")).alias("wide"),
                (~letter & x.rlike(OPENS)).alias("opens"), (letter | bare.rlike(CONTINUES)).alias("goes"), lower.alias("lower"), (wide & bare.rlike(f"^[{WIDE}]")).alias("first"),
            )

        width = F.length(x) + F.when(wide, _many(x, WIDE)).otherwise(0)
        return let(F.struct(width.alias("w"), lead.alias("lead"), ink.alias("ink"), dense.alias("dense"), F.substring(bare, 1, _HEAD).alias("head"), (F.instr(F.lit(ENDS), F.right(bare, F.lit(1))) > 0).alias("ends")), parts)

    return let(F.btrim(x, F.lit(" \t")), of)


#: How a line begins: on its own, after the line before and a space, right after it, right after it without its hyphen.
ALONE, SPACED, CLOSE, HYPHEN = range(4)


def _seam(s: Column, y: Column, width: Column) -> Column:
    """How line ``y`` goes on after the lines ``s``, in a paragraph of that width."""
    hyphen = s["hyphen"] & y["lower"]
    wrapped = (width >= MIN_WRAP) & (s["w"] >= width - WRAP_SLACK)
    joins = ~y["opens"] & (hyphen | (wrapped & y["goes"] & ~s["coded"] & ~y["coded"]))
    return F.when(~joins, ALONE).when(hyphen, HYPHEN).when(s["wide"] & y["first"], CLOSE).otherwise(SPACED)


def _alone(y: Column) -> Column:
    return F.struct(*[y[f].alias(f) for f in (x.split(":")[0] for x in _JOINED[7:-1].split(","))])


def _added(s: Column, y: Column, seam: Column) -> Column:
    """The summary of ``s`` and ``y`` joined."""
    less, more = F.when(seam == HYPHEN, 1).otherwise(0), F.when(seam == SPACED, 1).otherwise(0)
    n = s["n"] - less
    start = F.concat(F.substring(s["head"], F.lit(1), F.least(n, F.lit(_HEAD))), F.repeat(F.lit(" "), more), y["head"])

    def of(p: Column) -> Column:
        return F.struct((s["w"] - s["trail"] - less + more + y["w"] - y["lead"]).alias("w"), y["trail"].alias("trail"), p["ink"].alias("ink"), p["dense"].alias("dense"), p["head"].alias("head"), (n + more + y["n"]).alias("n"), _coded(y["ends"], p["head"], p["dense"], p["ink"]).alias("coded"), y["hyphen"].alias("hyphen"), y["wide"].alias("wide"))

    head = F.when(n >= _HEAD, s["head"]).otherwise(F.substring(start, 1, _HEAD))
    return let(F.struct((s["ink"] - less + y["ink"]).alias("ink"), (s["dense"] + y["dense"]).alias("dense"), head.alias("head")), of)


def reflow(items: Column, wide: Column | None = None) -> Column:
    """The text of (kind, text) ``items``, the lines of prose paragraphs joined where they were wrapped. ``wide`` may
    say that no line has wide characters."""
    wide = F.lit(True) if wide is None else wide

    def paragraph(ys: Column) -> Column:
        """How each line of a paragraph begins."""

        def fold(width: Column) -> Column:
            def step(s: Column, y: Column) -> Column:
                return let(_seam(s, y, width), lambda seam: going(F.when(seam == ALONE, _alone(y)).otherwise(_added(s, y, seam)), seam))

            rest = walk(F.slice(ys, F.lit(2), F.size(ys)), _alone(F.get(ys, F.lit(0))), step, _JOINED, "int")["out"]
            return F.concat(F.array(F.lit(ALONE)), rest)

        seamless = F.array_repeat(F.lit(ALONE), F.size(ys))
        return F.when(F.size(ys) < 2, seamless).otherwise(let(F.array_max(F.transform(ys, lambda y: y["w"])), fold))

    def joined(ys: Column) -> Column:
        # paragraphs lie between lines that are no prose; each of those begins on its own
        breaks = F.filter(F.transform(ys, lambda y, i: F.when(y.isNull(), i)), lambda i: i.isNotNull())

        def seams(at: Column) -> Column:
            starts = F.concat(F.array(F.lit(0)), F.transform(at, lambda i: i + 1))
            ends = F.concat(at, F.array(F.size(ys)))
            parts = F.zip_with(starts, ends, lambda a, b: F.when(b > a, paragraph(F.slice(ys, a + 1, b - a))).otherwise(F.array().cast("array<int>")))
            return F.flatten(F.transform(parts, lambda p, k: F.when(k > 0, F.concat(F.array(F.lit(ALONE)), p)).otherwise(p)))

        return let(let(breaks, seams), lambda ss: F.array_join(F.zip_with(items, F.transform(ss, lambda x, i: F.struct(x.alias("before"), F.coalesce(F.get(ss, i + 1), F.lit(ALONE)).alias("after"), i.alias("i"))), piece), ""))

    def piece(y: Column, at: Column) -> Column:
        text = F.when(at["before"] == ALONE, y["text"]).otherwise(F.ltrim(y["text"], F.lit(" \t")))
        text = F.when(at["after"] == ALONE, text).otherwise(F.rtrim(text, F.lit(" \t")))
        text = F.when(at["after"] == HYPHEN, F.regexp_replace(text, "-$", "")).otherwise(text)
        return F.concat(F.when((at["before"] == ALONE) & (at["i"] > 0), "\n").when(at["before"] == SPACED, " ").otherwise(""), text)

    return let(F.transform(items, lambda y: F.when((y["kind"] == "prose") & (F.btrim(y["text"], F.lit(" \t")) != ""), _line(y["text"], wide))), joined)


def clean(t: Column, *, reflow_wraps: bool = True, strip_markdown: bool = False, tidy_prose: bool = False) -> Column:
    """The whole cleaning of a text; the text itself stays where it is, so nothing is lost."""
    # escapes and invisible characters hold no line ends, so they go from the whole text at once; most texts have none, and
    # that is cheap to see. Repeating these steps costs less than another level of let-bindings for the analyzer.
    raw = F.when(t.contains("\r"), T.normalize_newlines(t)).otherwise(t)
    code = F.when(raw.contains("\x1b"), T.strip_escapes(raw)).otherwise(raw)
    views = F.struct(F.split(raw, "\n").alias("raw"), F.split(code, "\n").alias("code"), F.split(T.strip_invisible(code), "\n").alias("bare"), _boxed(raw).alias("box"), ((F.octet_length(raw) > F.length(raw)) & raw.rlike(f"[{WIDE}]")).alias("wide"))

    def parts(v: Column) -> Column:
        def line(k: Column, i: Column) -> Column:
            bare = F.get(v["bare"], i)
            prose = F.when(v["box"] & _boxed(bare), T.clean_prose_line(bare)).otherwise(F.rtrim(bare, F.lit(" \t")))
            text = F.when(k == "code", F.get(v["code"], i)).when(k == "table", F.when(_separator(bare), "").otherwise(T.table_cells(bare))).otherwise(prose)
            return F.struct(k.alias("kind"), text.alias("text"))

        # a table's separators and empty rows go
        items = F.filter(let(kinds(v["raw"]), lambda ks: F.transform(ks, line)), lambda y: (y["kind"] != "table") | (y["text"] != ""))
        items = _tidy(items) if tidy_prose else items
        return let(items, lambda ys: reflow(ys, v["wide"]) if reflow_wraps else F.array_join(F.transform(ys, lambda y: y["text"]), "\n"))

    out = F.when(t.isNotNull(), let(views, parts))
    return T.to_plain_text(out) if strip_markdown else out
