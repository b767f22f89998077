"""Quality rules as weak supervision (DataFrame functions only).

Six rules vote good (1), bad (-1) or abstain (0) on each text; expectation-maximisation estimates
their accuracies from the votes of all documents, and the posterior probability of good quality
decides, in place of a list of rules that must all pass. No label is read.

Defined results: a null text has no words (all counts 0). Empty tables give empty results. Rows are
judged one by one, so repeated rows and null ids repeat their verdict. Whole texts are read. Other
columns stay; one that is named as an added column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import weak
from .common import SPACES, carrying, cut, let, settle

SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("symbols", "repeats", "lines", "capitals", "word_length", "exclamations")


def _count(text: Column, pattern: str) -> Column:
    """How many characters of ``text`` belong to runs that match ``pattern``."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _covered(starts: Column) -> Column:
    """Words covered by three-word windows at the ascending ``starts``; overlaps count once."""
    n = F.size(starts)
    gaps = F.zip_with(F.slice(starts, 2, n - 1), F.slice(starts, 1, n - 1), lambda b, a: F.least(b - a, F.lit(3)))
    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda a, x: a + x))


def _starts_by_sort(hashes: Column) -> Column:
    """Ascending starts of the windows whose hash occurs again."""

    def starts(s: Column) -> Column:
        kept = F.filter(s, lambda x, i: F.when(i > 0, s[i - 1]["h"] == x["h"]).otherwise(False) | F.when(i < F.size(s) - 1, s[i + 1]["h"] == x["h"]).otherwise(False))
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), starts)


def signals(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the five counts of :data:`SIGNALS` (long) and ``base_failed``; every other column stays.

    Three-word windows are compared by a 64-bit hash. The hashes of a text are sorted to find those
    that occur again; the few windows with one of them are looked up, and only a text with very many
    repeats sorts its windows by place as well.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACES))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")))
    hashes = F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)))
    df = df.withColumn("_h", hashes).withColumn("_s", F.when(F.size(F.array_distinct("_h")) == F.size("_h"), none).otherwise(F.sort_array("_h")))
    df = df.withColumn("_d", F.when(F.size("_s") == 0, none).otherwise(F.array_distinct(F.filter("_s", lambda x, i: F.when(i > 0, F.get("_s", i - 1) == x).otherwise(False)))))
    few = F.transform(F.filter(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: F.array_contains("_d", x["h"])), lambda x: x["i"])
    starts = F.when(F.size("_d") <= 32, few).otherwise(_starts_by_sort(F.col("_h")))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    out = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": _count(t, "[#*$%&|<>]+").cast("long"),
            "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
            "n_repeat_words": F.when(F.size("_d") == 0, 0).otherwise(let(starts, _covered)).cast("long"),
        }
    )
    return out.drop("_w", "_h", "_s", "_d").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def votes(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``votes``, one entry per rule of :data:`RULES`. A text without words gets abstentions only."""
    t = F.coalesce(F.col(text), F.lit(""))
    n, some = F.col("n_words"), F.greatest(F.col("n_words"), F.lit(1))

    def rule(value: Column, good: float, bad: float) -> Column:
        return F.when(n == 0, 0).when(value <= good, 1).when(value >= bad, -1).otherwise(0)

    length = F.col("word_chars") / some
    return df.withColumn(
        "votes",
        F.array(
            rule(F.col("n_symbols") / some, 0.02, 0.1),
            rule(F.col("n_repeat_words") / some, 0.1, 0.5),
            rule(F.col("n_dup_lines") / F.size(F.split(t, "\n")), 0.1, 0.4),
            rule(_count(t, "\\p{Lu}+") / F.greatest(F.col("word_chars"), F.lit(1)), 0.1, 0.3),
            F.when(n == 0, 0).when(length.between(3.5, 7), 1).when((length < 2.5) | (length > 7.2), -1).otherwise(0),
            rule((F.size(F.split(t, "!")) - 1) / some, 0.05, 0.3),
        ),
    )


def judge(df: DataFrame, text: str = "text", *, keep_text: bool = True, threshold: float = 0.5) -> DataFrame:
    """Add the signals, ``quality`` (posterior of good, double) and ``kept`` to every row of ``df``.

    ``kept`` is false where ``base_failed``; else true if ``quality >= threshold``. Without
    ``keep_text`` the text column goes and the texts are read once, since the votes are checkpointed;
    with it, texts are read once for the fit and once for the verdict, and nothing is written.
    """

    def work(rows: DataFrame) -> DataFrame:
        return _judge(rows, text, keep_text, threshold)

    return carrying(df, [text], [*SIGNALS, "base_failed", "votes", "quality", "kept"], work, () if keep_text else (text,))


def _judge(df: DataFrame, text: str, keep_text: bool, threshold: float) -> DataFrame:
    voted = settle(votes(signals(df, text), text), *SIGNALS, "base_failed", "votes").drop(text)
    if not keep_text:
        voted = cut(voted)
    model = weak.fit(voted.select("votes"), "votes", len(RULES), learn_prior=False)
    scored = voted.withColumn("quality", weak.posterior(model, "votes"))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
