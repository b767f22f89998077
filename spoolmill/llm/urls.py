"""URL rules by a sort-merge range join (DataFrame functions only).

A rule (host, path) fits a url whose host is the rule's or a subdomain of it, and whose path starts
with the rule's path. Under the reversed host (``com.example``) followed by the path, a rule is the
interval of all keys that begin with it. A url has one key for each of its host's suffixes that some
rule names; rules and keys are sorted together, and a sweep carries the stack of rules open at each
place: the rules nested around the last one passed. The longest rule on the stack that still covers
the key wins.

Distinct (host, path) pairs are swept, so many rows of one url cost one key; sort ranges are cut by
key values, so many urls of one host spread over ranges. The stack of a range's start comes from one
row per range.

Defined results: null urls and urls without ``://`` have an empty host and path and fit no rule.
Every input row comes back once, also repeated rows and null ids. Of rules of equal length the one
with the longer host wins. Empty tables give empty results. Other columns stay; one that is named as an
added column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carrying, ranged

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict) of the registered query (fixed values).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``: what follows the first ``://`` up to ``/ ? #``, ASCII lower case,
    and then up to ``? #``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _AZ, _az)
    return df.withColumn("host", host).withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, "\\.")), ".")


def rule_table(spark, rules=RULES) -> DataFrame:
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _stacks(rules: DataFrame) -> DataFrame:
    """Rules by reversed host, each with the stack of rules around it (itself included).

    A rule's ancestors are found by an equi-join on its path's prefixes, only of lengths that occur.
    """
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block beats allow
    item = F.struct(F.length("path").alias("length"), "path", "verdict")
    lengths = rules.agg(F.collect_set(F.length("path")).alias("lengths"))  # as many as path lengths
    each = rules.join(F.broadcast(lengths)).select("host", F.col("path").alias("of"), F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    up = each.withColumn("path", F.expr("substring(of, 1, n)")).join(rules, ["host", "path"])
    return up.groupBy("host", "of").agg(F.sort_array(F.collect_list(item)).alias("stack")).select(_reversed(F.col("host")).alias("key"), F.col("of").alias("path"), "stack")


def judge(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (``host`` and ``path`` joined, or null) and ``verdict``."""
    return carrying(df, [url], ["host", "path", "rule", "verdict"], lambda rows: _judge(rows, rules, url, default))


def _judge(df: DataFrame, rules: DataFrame, url: str, default: str) -> DataFrame:
    df = split_url(df, url)
    urls = df.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    deep = rules.agg(F.collect_set(F.size(F.split("host", "\\."))).alias("sizes"))  # as many as lengths of rules' hosts
    suffixes = F.transform(F.filter("sizes", lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    keys = urls.join(F.broadcast(deep)).select("host", "path", F.explode(suffixes).alias("on")).join(rules.select(F.col("host").alias("on")).distinct(), "on", "left_semi")
    keys = keys.select(_reversed(F.col("on")).alias("key"), "path", F.lit(1).alias("kind"), "host", F.lit(None).cast("array<struct<length:int,path:string,verdict:string>>").alias("stack"))
    opened = _stacks(rules).select("key", "path", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "stack")
    rows = ranged(keys.unionByName(opened), "key", "path", "kind", "host")
    here = F.when(F.col("kind") == 0, F.struct("key", "stack"))
    last = rows.withColumn("_open", here).groupBy("_pid").agg(F.max_by("_open", F.when(F.col("kind") == 0, F.struct("key", "path"))).alias("_open"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    start = last.select("_pid", F.last("_open", ignorenulls=True).over(before).alias("_before"))
    sweep = Window.partitionBy("_pid").orderBy("key", "path", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.withColumn("_now", F.last(here, ignorenulls=True).over(sweep)).join(F.broadcast(start), "_pid", "left").where("kind = 1")
    opened_now = F.coalesce("_now", "_before")
    fits = F.filter(F.when(opened_now["key"] == F.col("key"), opened_now["stack"]), lambda r: F.col("path").startswith(r["path"]))
    best = F.get(fits, F.size(fits) - 1)
    on = F.array_join(F.reverse(F.split("key", "\\.")), ".")
    hits = swept.where(F.size(fits) > 0).select("host", "path", F.struct((F.length("key") + best["length"]).alias("size"), F.length("key").alias("host_size"), F.concat(on, best["path"]).alias("rule"), best["verdict"].alias("verdict")).alias("hit"))
    won = hits.groupBy(F.col("host").alias("_h"), F.col("path").alias("_p")).agg(F.max("hit").alias("hit"))
    out = df.join(won, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return out.withColumn("rule", F.col("hit.rule")).withColumn("verdict", F.coalesce("hit.verdict", F.lit(default))).drop("_h", "_p", "hit")


ORACLE = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, rv) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block'))
SELECT page_id, host, path,
  (SELECT rh || rp FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC, length(rh) DESC LIMIT 1) AS rule,
  coalesce((SELECT rv FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC, length(rh) DESC LIMIT 1), 'allow') AS verdict
FROM h
"""
