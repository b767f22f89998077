"""Weak supervision: expectation-maximisation over the votes of labelling rules, in SQL.

Votes are an ``array<int>`` of 1 (for), -1 (against) and 0 (abstains). All rows are first grouped by
vote pattern; K rules have at most 3^K patterns, whatever the number of rows, and the fit runs as a
fold over that one bounded array. A rule is described by how often it votes either way on rows of
either class; an abstention says nothing about the class.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of positives voted for, of positives voted against, of negatives voted for and against.
START = (0.9, 0.01, 0.75, 0.4)


@dataclass(frozen=True)
class Reliability:
    """``prior`` of the positive class and, by rule, the four shares described at :data:`START`."""

    prior: float
    rates: tuple[tuple[float, float, float, float], ...]


def fit(votes: DataFrame, column: str, rules: int, *, prior: float = 0.5, start: tuple[float, float, float, float] = START, rounds: int = 25, weight: float = 10.0, learn_prior: bool = True) -> Reliability:
    """Estimate each rule's reliability from all rows of ``votes``.

    ``weight`` pseudo-rows at ``start`` hold the two classes in place and keep a rule that hardly
    fires near its start. No rows: the starting values. Null votes count as no row. Without
    ``learn_prior`` the posterior compares the classes' likelihoods alone, so that a large majority
    of clean rows cannot outvote one strong rule.
    """
    if not 1 <= rules <= 10:
        raise ValueError("1 to 10 rules")
    patterns = votes.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").cast("double").alias("n"))
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("ps"))
    zero, ks = F.lit(0.0), F.sequence(F.lit(1), F.lit(rules))
    first = F.struct(F.lit(float(prior)).alias("pi"), F.transform(ks, lambda _: F.struct(*[F.lit(float(x)).alias(c) for x, c in zip(start, "abcd", strict=True)])).alias("rates"))

    def add(items: Column, f) -> Column:
        return F.aggregate(items, zero, lambda a, x: a + f(x))

    def step(state: Column) -> Column:
        def odds(p: Column) -> Column:
            each = F.zip_with(p["v"], state["rates"], lambda v, r: F.when(v > 0, F.log(r["a"] / r["c"])).when(v < 0, F.log(r["b"] / r["d"])).otherwise(zero))
            return F.log(state["pi"] / (1 - state["pi"])) + F.aggregate(each, zero, lambda a, x: a + x)

        seen = F.transform(F.col("ps"), lambda p: F.struct(p["v"].alias("v"), (p["n"] / (1 + F.exp(-odds(p)))).alias("y"), (p["n"] / (1 + F.exp(odds(p)))).alias("z")))

        def rule(s: Column, k: Column) -> Column:
            def rate(side: str, sign: int, at: float) -> Column:
                hits = add(s, lambda x: F.when(F.element_at(x["v"], k) == sign, x[side]).otherwise(zero))
                return F.greatest(F.lit(1e-4), F.least(F.lit(0.9999), (hits + weight * at) / (add(s, lambda x: x[side]) + weight)))

            return F.struct(*[rate(side, sign, at).alias(c) for side, sign, at, c in zip("yyzz", (1, -1, 1, -1), start, "abcd", strict=True)])

        def next_state(s: Column) -> Column:
            share = F.lit(float(prior)) if not learn_prior else (add(s, lambda x: x["y"]) + weight * prior) / (add(s, lambda x: x["y"] + x["z"]) + weight)
            return F.struct(share.alias("pi"), F.transform(ks, lambda k: rule(s, k)).alias("rates"))

        return F.transform(F.array(seen), next_state)[0]

    got = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda s, _: step(s)).alias("m")).first()["m"]
    return Reliability(got["pi"], tuple(tuple(r) for r in got["rates"]))


def posterior(model: Reliability, votes: Column | str) -> Column:
    """Probability of the positive class given one row's votes (null votes: null)."""
    votes = F.col(votes) if isinstance(votes, str) else votes
    odds = F.lit(log(model.prior / (1 - model.prior)))
    for k, (a, b, c, d) in enumerate(model.rates):
        odds = odds + F.when(votes[k] > 0, log(a / c)).when(votes[k] < 0, log(b / d)).otherwise(0.0)
    return F.when(votes.isNotNull(), 1 / (1 + F.exp(-odds)))
