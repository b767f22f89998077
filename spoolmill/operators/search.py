"""Ranked and literal search over (path, title, body, project, last_active_at) rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("title", "body", "project")


def _grams(c: str) -> Column:
    return F.greatest(F.coalesce(F.length(c), F.lit(0)) - 2, F.lit(0))


def size() -> Column:
    """How many trigrams a row has."""
    return sum((_grams(c) for c in COLUMNS), F.lit(0))


def score(n: Column, hits: Column, found: Column, own: Column, mean: Column) -> Column:
    """BM25 of one phrase with the sign turned, so that the best is the least: ``found`` times in a row of size ``own``."""
    idf = F.log((n - hits + 0.5) / (hits + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    return -idf * found * 2.2 / (found + 1.2 * (0.25 + 0.75 * own / mean))


def bm25(rows: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Queries of three characters or more: case-insensitive substring of any column, ranked by BM25
    over trigrams (best, the least score, first; ties by path). Statistics cover all rows; they are
    one row."""
    q = query.strip().lower()
    # a zero-width lookahead counts overlapping matches
    count = sum((F.coalesce(F.regexp_count(F.lower(c), F.lit(f"(?={re.escape(q)})")), F.lit(0)) for c in COLUMNS), F.lit(0))
    hit = F.lit(False)
    for c in COLUMNS:
        hit = hit | F.coalesce(F.lower(c).contains(q), F.lit(False))
    stats = rows.agg(F.count("*").alias("_all"), F.avg(size()).alias("_avg"), F.count_if(hit).alias("_hits"))
    found = rows.where(hit).withColumns({"_f": count, "_d": size()}).join(F.broadcast(stats))
    return found.withColumn("score", score(F.col("_all"), F.col("_hits"), F.col("_f"), F.col("_d"), F.col("_avg"))).orderBy("score", "path").limit(limit).drop("_f", "_d", "_all", "_avg", "_hits")


def like(rows: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Shorter queries: substring, ASCII case folding only, newest first."""
    az, AZ = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    q = query.strip().translate(str.maketrans(AZ, az))
    hit = F.lit(False)
    for c in COLUMNS:
        hit = hit | F.coalesce(F.instr(F.translate(c, AZ, az), q) > 0, F.lit(False))
    return rows.where(hit).orderBy(F.desc("last_active_at"), "path").limit(limit)


def search(rows: DataFrame, query: str, limit: int = 50) -> DataFrame:
    q = query.strip()
    if not q:
        return rows.limit(0)
    return bm25(rows, q, limit) if len(q) >= 3 else like(rows, q, limit)


def _place(body: Column, q: str) -> Column:
    """Where ``q`` begins, whatever its case. The one character that grows in lower case is replaced
    first, so that places in the lowered text are places in the text."""
    return F.instr(F.lower(F.replace(body, F.lit("\u0130"), F.lit("\u0131"))), q.lower())


def snippet(body: Column, query: str, around: int = 30, empty: int = 60) -> Column:
    """The first match in «» with up to ``around`` characters on either side."""
    q = query.strip()
    at = _place(body, q)
    start = F.greatest(at - around, F.lit(1))
    left = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(body, start, at - start), F.lit("«"), F.substring(body, at, F.lit(len(q))), F.lit("»"))
    right = F.concat(F.substring(body, at + len(q), F.lit(around)), F.when(at + len(q) + around <= F.length(body), "…").otherwise(""))
    head = F.concat(F.substring(body, 1, empty), F.when(F.length(body) > empty, "…").otherwise(""))
    return F.when(at > 0, F.concat(left, right)).when(F.length(body) > 0, head).otherwise(f"«{q}»")


def ranked_snippet(body: Column, query: str, size: int = 20) -> Column:
    """A window of ``size`` trigrams of ``body`` around its first match, which is put in «»; without a match
    the window is the start of the text. Ellipses stand where text is left out."""
    q = query.strip()
    length, span = F.length(body), size + 2
    at = _place(body, q)
    start = F.greatest(F.least(at - (size - (len(q) - 2)) // 2, length - span + 1), F.lit(1))
    start = F.when(at > 0, start).otherwise(1)
    shown = F.substring(body, start, F.lit(span))
    before, hit, after = F.substring(body, start, at - start), F.substring(body, at, F.lit(len(q))), F.substring(body, at + len(q), F.greatest(start + span - at - len(q), F.lit(0)))
    text = F.when(at > 0, F.concat(before, F.lit("«"), hit, F.lit("»"), after)).otherwise(shown)
    return F.concat(F.when(start > 1, "…").otherwise(""), text, F.when(start + span <= length, "…").otherwise(""))


def known_tools(hits: DataFrame, tools: tuple[str, ...]) -> DataFrame:
    """Hits of tools that are known; the limit has been taken before."""
    return hits.where(F.col("tool").isin(*tools))
