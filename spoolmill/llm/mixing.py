"""Mixing sources to target weights by hierarchical budgets (DataFrame functions only).

The tree is domain, language, source. From the root down, a node's budget is shared among its
children by weight; a child that cannot use its share, even by repeating its documents, is filled
and the rest goes to its siblings by weight. Because a node's capacity is that of all its leaves, a
shortage is made good among siblings first and reaches a parent's siblings only when the whole
parent is full.

A leaf spends its budget in epochs: whole passes over its documents, then the prefix of one more
pass in seeded order, up to the exact token; the last document of that prefix is cut.

Sums are whole numbers; a share is rounded down, so up to one token per node of a level stays
unspent. Token counts times the sum of sibling weights must stay below 2^63.

Defined results: a token is a word. Null and blank texts have no tokens and are never taken. Null
languages and sources are leaves of their own. Ties of the seeded order (repeated rows) are broken
arbitrarily among equal rows. A budget of 0 or an empty table gives an empty result. Other columns stay;
one that is named as an added column is replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, carrying, cut, settle

LEVELS = ("domain", "lang", "source")
#: Weights of the registered query (fixed values); anything else weighs 1.
WEIGHTS: Mapping[str, Mapping[str, int]] = {"domain": {"web": 3, "books": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}
SEED, EPOCHS = 17, 2
#: Up to this many leaves the leaf table (under 200 bytes a row) is broadcast; beyond, Spark joins by key.
BROADCAST_LEAVES = 100_000
DIGITS = 3  # hexadecimal digits of the order key that make a bucket: 4096 buckets a leaf


def domain_of(source: Column) -> Column:
    """Sources whose name ends in 0 to 4 are web, others books."""
    return F.when(source.rlike("[0-4]$"), "web").otherwise("books")


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1).cast("long")
    for name, value in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(value).cast("long")).otherwise(out)
    return out


def _fill(nodes: DataFrame, parents: list[str], key: str) -> DataFrame:
    """Share ``budget`` among siblings by ``weight`` up to ``capacity``: adds ``share``.

    Siblings fill up in order of capacity per weight; the level of the water is known at the first
    one that it doesn't fill.
    """
    of = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(1))
    order = of.orderBy(F.col("capacity") / F.col("weight"), key)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    out = nodes.withColumn("_left", F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("_w", F.sum("weight").over(after))
    out = out.withColumn("_full", F.col("capacity") * F.col("_w") <= F.col("weight") * F.col("_left"))
    spent = F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0)).over(of)
    heavy = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(of)
    out = out.withColumn("_s", spent).withColumn("_h", heavy)
    return out.withColumn("share", F.when(F.col("_full"), F.col("capacity")).otherwise(F.expr("(weight * (budget - _s)) div _h"))).drop("_left", "_w", "_full", "_s", "_h")


def budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, *, part: tuple[int, int] = (1, 1), epochs: int = EPOCHS) -> DataFrame:
    """``leaves`` has (domain, lang, source, tokens); adds ``budget`` for each leaf. The total is
    ``part`` (numerator, denominator) of all tokens."""
    table = leaves.withColumn("capacity", F.col("tokens") * epochs)
    total = table.groupBy("domain").agg(F.sum("tokens").alias("tokens"), F.sum("capacity").alias("capacity")).withColumn("weight", _weight("domain", weights))
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    domains = _fill(total.withColumn("_all", whole).withColumn("budget", F.expr(f"(_all * {part[0]}) div {part[1]}")).drop("_all"), [], "domain").select("domain", F.col("share").alias("budget"))
    langs = table.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight("lang", weights)).join(domains, "domain")
    langs = _fill(langs, ["domain"], "lang").select("domain", F.col("lang").alias("_lang"), F.col("share").alias("budget"))
    on = table.withColumn("weight", _weight("source", weights)).join(langs.withColumnRenamed("domain", "_domain"), (F.col("domain") == F.col("_domain")) & F.col("lang").eqNullSafe(F.col("_lang"))).drop("_domain", "_lang")
    return _fill(on, ["domain", "lang"], "source").select(*LEVELS, "tokens", F.col("share").alias("budget"))


def _order(epoch: Column, seed: int, doc: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col(doc).cast("string"), F.lit(""))))


def select(df: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, *, part: tuple[int, int] = (1, 1), epochs: int = EPOCHS, seed: int = SEED, text: str = "text", doc: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """One row per document and epoch in which it is taken: the input's columns and ``domain``,
    ``n_tokens``, ``epoch`` and ``take`` (tokens taken, from the start of the text).

    Texts are never shuffled: leaf totals, and where each leaf's last epoch ends, are small tables.
    """

    def work(rows: DataFrame) -> DataFrame:
        return _select(rows, weights, part, epochs, seed, text, doc, keep_text)

    return carrying(df, [text, doc, "lang", "source"], ["domain", "n_tokens", "epoch", "take"], work, () if keep_text else (text,))


def _select(df: DataFrame, weights: Mapping[str, Mapping[str, int]], part: tuple[int, int], epochs: int, seed: int, text: str, doc: str, keep_text: bool) -> DataFrame:
    counted = df.withColumn("domain", domain_of(F.col("source"))).withColumn("n_tokens", F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long"))
    counted = settle(counted, "domain", "n_tokens").drop(text)
    if not keep_text:
        counted = cut(counted)
    small = counted.select(*LEVELS, doc, "n_tokens") if not keep_text else cut(counted.select(*LEVELS, doc, "n_tokens"))
    plan = cut(budgets(small.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), weights, part=part, epochs=epochs))
    plan = plan.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], F.expr("budget div tokens").alias("_full"), F.expr("budget % tokens").alias("_rest"))
    side = F.broadcast if plan.count() <= BROADCAST_LEAVES else lambda x: x
    same = _same(list(LEVELS))
    names = [f"_{c}" for c in LEVELS]

    # Where each leaf's last, partial epoch ends: first the bucket, then the row.
    last = small.where("n_tokens > 0").join(side(plan), same).where("_rest > 0").withColumn("_key", _order(F.col("_full"), seed, doc)).withColumn("_bucket", F.substring("_key", 1, DIGITS))
    filled = last.groupBy(*names, "_rest", "_bucket").agg(F.sum("n_tokens").alias("_n"))
    by = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows a leaf
    ends = filled.withColumn("_before", F.coalesce(F.sum("_n").over(by), F.lit(0))).where("_before < _rest AND _before + _n >= _rest").select(*[F.col(c).alias(f"_{c}") for c in names], F.col("_bucket").alias("_end"), "_before")
    ends = cut(plan.join(ends, _same(names), "left").select(*names, "_full", "_rest", "_end", "_before"))
    taken = counted.where("n_tokens > 0").join(side(ends), same).drop(*names)
    taken = taken.withColumn("_key", _order(F.col("_full"), seed, doc)).withColumn("_bucket", F.substring("_key", 1, DIGITS))

    # whole passes, and the last one for rows before its end
    passes = F.expr("concat(if(_full > 0, sequence(0L, _full - 1), array()), if(_rest > 0 AND _bucket < _end, array(_full), array()))")
    sure = taken.withColumn("epoch", F.explode(passes)).withColumn("take", F.col("n_tokens"))
    edge = taken.where("_rest > 0 AND _bucket = _end")
    run = Window.partitionBy(*LEVELS).orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)  # one bucket of each leaf
    at = F.col("_before") + F.coalesce(F.sum("n_tokens").over(run), F.lit(0))
    edge = edge.withColumn("epoch", F.col("_full")).withColumn("take", F.least(F.col("n_tokens"), F.col("_rest") - at)).where("take > 0")
    gone = ("_full", "_rest", "_end", "_before", "_key", "_bucket")
    return sure.unionByName(edge).withColumn("epoch", F.col("epoch").cast("long")).drop(*gone)


def _same(names: list[str]) -> Column:
    """Null-safe equality of each name with its underscored twin."""
    out = F.lit(True)
    for c in names:
        out = out & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out


def cut_text(text: Column, take: Column, n_tokens: Column) -> Column:
    """The first ``take`` words of ``text`` and what stands before and between them."""
    pieces = F.regexp_extract_all(text, F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0))
    return F.when(take >= n_tokens, text).otherwise(F.array_join(F.slice(pieces, 1, take), ""))


ORACLE = r"""
WITH t AS (SELECT doc_id, lang, source, CASE WHEN regexp_matches(source, '[0-4]$') THEN 'web' ELSE 'books' END AS domain,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
l AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, 2 * sum(n_tokens)::BIGINT AS capacity, 1::BIGINT AS weight FROM t GROUP BY ALL HAVING sum(n_tokens) > 0),
d0 AS (SELECT domain, sum(capacity)::BIGINT AS capacity, CASE domain WHEN 'web' THEN 3 ELSE 2 END::BIGINT AS weight, (SELECT sum(tokens) FROM l)::BIGINT AS budget FROM l GROUP BY domain),
d1 AS (SELECT *, capacity * sum(weight) OVER (ORDER BY capacity / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= weight * (budget - coalesce(sum(capacity) OVER (ORDER BY capacity / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled FROM d0),
d2 AS (SELECT domain, CASE WHEN filled THEN capacity ELSE (weight * (budget - coalesce(sum(capacity) FILTER (filled) OVER (), 0))) // sum(weight) FILTER (NOT filled) OVER () END AS budget FROM d1),
g0 AS (SELECT l.domain, lang, sum(capacity)::BIGINT AS capacity, CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END::BIGINT AS weight, any_value(d2.budget) AS budget FROM l JOIN d2 ON l.domain = d2.domain GROUP BY l.domain, lang),
g1 AS (SELECT *, capacity * sum(weight) OVER (PARTITION BY domain ORDER BY capacity / weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= weight * (budget - coalesce(sum(capacity) OVER (PARTITION BY domain ORDER BY capacity / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled FROM g0),
g2 AS (SELECT domain, lang, CASE WHEN filled THEN capacity ELSE (weight * (budget - coalesce(sum(capacity) FILTER (filled) OVER (PARTITION BY domain), 0))) // sum(weight) FILTER (NOT filled) OVER (PARTITION BY domain) END AS budget FROM g1),
s0 AS (SELECT l.*, g2.budget FROM l JOIN g2 ON l.domain = g2.domain AND l.lang IS NOT DISTINCT FROM g2.lang),
s1 AS (SELECT *, capacity * sum(weight) OVER (PARTITION BY domain, lang ORDER BY capacity / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= weight * (budget - coalesce(sum(capacity) OVER (PARTITION BY domain, lang ORDER BY capacity / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled FROM s0),
s2 AS (SELECT *, (CASE WHEN filled THEN capacity ELSE (weight * (budget - coalesce(sum(capacity) FILTER (filled) OVER (PARTITION BY domain, lang), 0))) // sum(weight) FILTER (NOT filled) OVER (PARTITION BY domain, lang) END)::BIGINT AS share FROM s1),
j AS (SELECT t.*, (share // tokens)::BIGINT AS passes, (share % tokens)::BIGINT AS rest FROM t JOIN s2 ON t.domain = s2.domain AND t.lang IS NOT DISTINCT FROM s2.lang AND t.source IS NOT DISTINCT FROM s2.source WHERE n_tokens > 0),
p AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || passes || ':' || coalesce(doc_id::VARCHAR, '')) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM j)
SELECT doc_id, domain, lang, source, n_tokens, epoch::BIGINT AS epoch, n_tokens AS take FROM (SELECT *, unnest(range(0, passes)) AS epoch FROM j)
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, passes AS epoch, least(n_tokens, rest - before)::BIGINT AS take FROM p WHERE rest > before
"""
