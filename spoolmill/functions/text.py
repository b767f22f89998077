"""Text cleaning as Column expressions: escape sequences, noise, lines, plain text, secrets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import going, walk

#: Terminal escape sequences: CSI, OSC (ended by BEL or ST), ESC and one character, a lone ESC.
ESCAPES = "\\x1b(?:\\[[\\x20-\\x3f]*[^\\n]?|\\][^\\x07\\x1b\\n]*(?:\\x07|\\x1b\\\\)?|[^\\[\\]\\n]?)"
INVISIBLE = "[\\x00-\\x08\\x0B-\\x1F\\x7F\\x{FEFF}\\x{200B}-\\x{200D}\\x{2060}]"
BOX = "[\\x{2500}-\\x{257F}]"
#: Openings of lines that a tool wrote into a user's message (fixed values).
BOILERPLATE = "^(</?local-command-|</?command-|</?system-reminder>|Caveat:|DO NOT respond)"
#: Publicly documented shapes of secrets (fixed values): assignments, key blocks, cloud keys, hub tokens.
SECRETS = {
    "assignment": "(?i)(?:token|password|api_key)[ ]?=[ ]?[\"']?[A-Za-z0-9]{12,}",
    "private_key": "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "cloud_key": "AKIA[0-9A-Z]{16}",
    "hub_token": "gh[opsu]_[A-Za-z0-9]{36}",
}
DIFF = "^(@@|diff |--- |\\+\\+\\+ |[-+][^ \\t])"


def normalize_newlines(t: Column) -> Column:
    return F.regexp_replace(t, "\\r\\n?", "\n")


def strip_escapes(t: Column) -> Column:
    """All that may be removed inside code."""
    return F.regexp_replace(t, ESCAPES, "")


def strip_noise(t: Column) -> Column:
    """For prose and tables: escapes and invisible characters go, no-break space becomes a space."""
    return strip_invisible(strip_escapes(t))


def strip_invisible(t: Column) -> Column:
    return F.replace(F.regexp_replace(t, INVISIBLE, ""), F.lit("\u00a0"), F.lit(" "))


def clean_prose_line(line: Column) -> Column:
    bare = F.regexp_replace(line, BOX, "")
    bare = F.when(line.rlike(f"^ *{BOX}"), F.regexp_replace(bare, "^[ \\t]+", "")).otherwise(bare)
    return F.regexp_replace(bare, "[ \\t]+$", "")


def is_separator(line: Column) -> Column:
    return line.contains("-") & line.rlike("^[|:\\- ]+$")


def is_pipe_row(line: Column) -> Column:
    return line.contains("|") & F.trim(line).rlike("[^| ]")


def is_blank(line: Column) -> Column:
    return ~line.rlike("[^ \\t]")


def table_cells(line: Column) -> Column:
    """A table's row without box characters and outer pipes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, BOX, ""), "^[ \\t]*\\|", ""), "\\|[ \\t]*$", ""), "^[\\p{Zs}\\t]+|[\\p{Zs}\\t]+$", "")


def clean_table_lines(lines: Column) -> Column:
    return F.filter(F.transform(F.filter(lines, lambda x: ~is_separator(x)), table_cells), lambda x: x != "")


def collapse_blanks(t: Column) -> Column:
    """Runs of blank lines become one empty line."""
    lines = F.split(t, "\n")
    keep = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), (is_blank(x) & F.when(i > 0, is_blank(F.get(lines, i - 1))).otherwise(False)).alias("again"))), lambda s: ~s["again"])
    return F.array_join(F.transform(keep, lambda s: F.when(is_blank(s["x"]), "").otherwise(s["x"])), "\n")


def plain_line(line: Column) -> Column:
    """One markdown line without its marks. What a line has no character for is not tried."""
    quoted = F.regexp_replace(line, "^([ \\t]*> ?)+", "")
    marked = F.when(quoted.rlike("^[ \\t]*#+ "), F.regexp_replace(quoted, "^[ \\t]*#+ ", "")).otherwise(F.regexp_replace(quoted, "^[ \\t]*([-*+]|[0-9]+[.)]) +", ""))
    marked = F.when(F.instr(F.lit(">#-*+0123456789"), F.substring(F.ltrim(line, F.lit(" \t")), 1, 1)) > 0, marked).otherwise(line)
    out = F.regexp_replace(marked, "!\\[([^\\]]*)\\]\\([^)]*\\)", "$1")
    out = F.regexp_replace(out, "\\[([^\\]]*)\\]\\(([^)]*)\\)", "$1 ($2)")
    out = F.regexp_replace(out, "`([^`]*)`", "$1")
    for mark in ("\\*\\*([^*]+)\\*\\*", "__([^_]+)__", "\\*([^*]+)\\*", "_([^_]+)_"):
        out = F.regexp_replace(out, mark, "$1")
    return F.when(line.contains("*") | line.contains("_") | line.contains("`") | line.contains("["), out).otherwise(marked)


def sanitize(session: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(session, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("session"))


def title(first_user: Column) -> Column:
    """From the first user message: its first line that is neither blank nor boilerplate."""
    lines = F.split(first_user, "\n")
    filled = F.filter(lines, lambda x: x.rlike("\\S"))
    good = F.filter(filled, lambda x: ~F.trim(x).rlike(BOILERPLATE))
    line = F.coalesce(F.get(good, F.lit(0)), F.get(filled, F.lit(0)), F.lit(""))
    return F.when(first_user.isNull(), "(untitled)").otherwise(F.substring(F.trim(line), 1, 80))


def recency(seconds: Column) -> Column:
    def unit(size: int, name: str) -> Column:
        return F.concat(F.floor(seconds / size).cast("string"), F.lit(name))

    return (
        F.when(seconds < 0, "now").when(seconds < 60, unit(1, "s")).when(seconds < 3600, unit(60, "m")).when(seconds < 86400, unit(3600, "h"))
        .when(seconds < 172800, "yesterday").when(seconds < 604800, unit(86400, "d")).when(seconds < 2592000, unit(604800, "w")).when(seconds < 31536000, unit(2592000, "mo")).otherwise(unit(31536000, "y"))
    )


def fenced(lines: Column) -> Column:
    """Booleans: which lines lie in a fenced block, marks included; an open fence runs to the end.
    A closing mark is at least as long as the opening one and stands alone."""

    has = lambda line: line.contains("```") | line.contains("~~~")

    def mark(line: Column) -> Column:
        run = F.length(F.regexp_extract(line, "^[ \\t]*(`{3,}|~{3,})", 1))
        return F.when(has(line), F.struct(run.alias("run"), (~line.rlike("^[ \\t]*`{3,}+[^`]*`")).alias("opens"), line.rlike("^[ \\t]*(`{3,}|~{3,})[ \\t]*$").alias("closes")))

    def step(s: Column, m: Column) -> Column:
        inside, opens = s["n"] > 0, m.isNotNull() & (m["run"] > 0) & m["opens"]
        n = F.when(m.isNull(), s["n"]).when(inside & m["closes"] & (m["run"] >= s["n"]), 0).when(inside, s["n"]).when(opens, m["run"]).otherwise(0)
        return going(F.struct(n.alias("n")), inside | F.coalesce(opens, F.lit(False)))

    walked = walk(F.transform(lines, mark), F.struct(F.lit(0)), step, "struct<n:int>", "boolean")["out"]
    return F.when(F.exists(lines, has), walked).otherwise(F.transform(lines, lambda _: F.lit(False)))


def to_plain_text(t: Column) -> Column:
    """A markdown document without its marks: fence lines go, code lines stay as they are, other lines
    lose their marks. Unlike in ``fenced``, a closing mark may be followed by an info string."""

    def step(s: Column, line: Column) -> Column:
        run = F.when(line.rlike("^[ \\t]*`{3,}+[^`]*`"), 0).otherwise(F.length(F.regexp_extract(line, "^[ \\t]*(`{3,}|~{3,})", 1)))
        run = F.when(line.contains("```") | line.contains("~~~"), run).otherwise(0)
        inside = s["n"] > 0
        mark = (run > 0) & (run >= s["n"])
        said = F.when(mark, F.array().cast("array<string>")).otherwise(F.array(F.when(inside, line).otherwise(plain_line(line))))
        return F.struct(F.struct(F.when(mark, F.when(inside, 0).otherwise(run)).otherwise(s["n"]).alias("n")).alias("s"), said.alias("out"))

    return F.array_join(walk(F.split(t, "\n"), F.struct(F.lit(0)), step, "struct<n:int>", "string")["out"], "\n")


def metadata_line(label: Column, day: Column, project: Column, turns: Column) -> Column:
    """What a record shows under its title; a missing project is left out."""
    return F.concat_ws(" · ", label, day, project, F.concat(turns.cast("string"), F.lit(" turns")))


def note_name(title: Column, body: Column) -> Column:
    """A note's file name: its title, else the first line that is not empty, 40 characters at most."""
    line = F.get(F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    name = F.coalesce(F.nullif(F.trim(title), F.lit("")), F.substring(line, 1, 40), F.lit("untitled"))
    return F.concat(F.regexp_replace(name, "/", "-"), F.lit(".md"))


def secret_hits(t: Column) -> Column:
    """How often each rule of :data:`SECRETS` matches: a map without the values."""
    return F.create_map(*[x for k, p in SECRETS.items() for x in (F.lit(k), F.regexp_count(t, F.lit(p)).cast("long"))])
