"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers read the words of a clause: insult (learned words), threat, target, negation and
reported speech. Each reads what the one before it writes; their composition is one machine, whose
states are built when they are met. It writes a match per insult or threat: plain, aimed at a target,
negated or reported. Guesses about words still to come are paths of their own, of which one survives.
A text's score is a logistic function of the weights of its matches. A listed word whose clause has no
other words is no match; only clauses with a learned or listed word are read word by word. A plain match
needs no target: the words around it only have to be a clause that neither negates nor reports it.

The insult lexicon and the weights are fitted on labelled rows alone whose crc32(doc_id) is not
divisible by 5, at most ``SAMPLE`` of them, chosen by a hash of the id. A word enters the lexicon by
the distinct contexts in which it occurs, so copies of one text count once.

Defined results: null and empty texts match nothing and get the base score. A null id counts as held
out. No labels (or an empty table): listed words alone, with the starting weights. Rows are scored one
by one, repeated rows and null ids included; of rows that share a labelled id the fit reads the least text.
Whole texts are read. Other columns are not read or kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from math import log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that the fit reads; the lexicon is bounded by their words.
SAMPLE = 12_000
#: Word lists of the fixed transducers (fixed values).
INSULTS = "idiot moron loser scum worthless pathetic disgusting stupid trash clown fool imbecile dumb idioten dummkopf abschaum crétin imbécile ordure estúpido basura idiota".split()
THREATS = "kill hurt destroy murder strangle shoot stab töten umbringen vernichten tuer frapper égorger matar golpear destruir".split()
TARGETS = "you your yours he she they him her them his their du dich dir ihr euch sie er tu te toi vous il elle ils usted tú él ella ellos".split()
NEGATIONS = "not never no isn't aren't wasn't don't nicht kein keine nie ne pas jamais non nunca jamás".split()
REPORTS = "said says wrote writes reported quoted claimed tweeted sagte schrieb berichtete dit écrit déclaré dijo escribió afirmó".split()
KINDS = ("plain", "aimed", "negated", "reported", "threat", "aimed_threat")
#: Starting weights of the logistic function: bias, then one per kind.
START = (-4.0, 2.5, 3.0, 0.3, 0.3, 2.0, 3.0)
#: Tokens over which a negation or a target reaches.
REACH = 3
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[\"“”„«»]")
_CLAUSE_END = re.compile(r"[.!?;:\n]")


#: The symbols of a clause's words, and the quotation mark, which is no word.
WORDS = ("other", "insult", "threat", "target", "negation", "report")
MATCHES = ("insult", "threat", "aimed", "aimed_threat")
ALPHABET = (*WORDS, "aimed", "aimed_threat", "negated", "reported", "quote")


class Transducer:
    """A finite-state transducer. ``arcs(state, symbol)`` lists (next state, output); a path may end in
    the states that ``final`` accepts. A symbol without arcs ends the path."""

    def __init__(self, start, arcs: Callable, final: Callable):
        self.start, self.final, self._arcs, self._known = start, final, arcs, {}

    def arcs(self, state, symbol: str) -> list[tuple]:
        got = self._known.get((state, symbol))
        if got is None:
            got = self._known[state, symbol] = list(self._arcs(state, symbol))
        return got

    def __matmul__(self, then: Transducer) -> Transducer:
        """The composition: ``then`` reads what this one writes. Its states are built when met."""

        def arcs(state, symbol):
            for here, between in self.arcs(state[0], symbol):
                for there, out in then.arcs(state[1], between):
                    yield (here, there), out

        return Transducer((self.start, then.start), arcs, lambda s: self.final(s[0]) and then.final(s[1]))

    def paths(self, symbols: list[str]) -> list[list[tuple[int, str]]]:
        """The outputs other than ``other`` of each accepting path, as (position, output)."""
        alive = [(self.start, None)]
        for i, symbol in enumerate(symbols):
            alive = [(to, found if out == "other" else (found, i, out)) for state, found in alive for to, out in self.arcs(state, symbol)]
        done = []
        for state, found in alive:
            if self.final(state):
                out = []
                while found is not None:
                    found, i, kind = found
                    out.append((i, kind))
                done.append(out[::-1])
        return done


def in_context(match: str) -> Transducer:
    """Keeps ``match`` where its clause has other words too; in a clause of such words alone it goes.
    A clause that begins with one is read on two paths, of which one survives."""

    def arcs(state, symbol):
        if symbol == "quote":
            return [(state, symbol)]
        if symbol != match:
            return [] if state == "alone" else [("context", symbol)]
        return {"begin": [("hoping", match), ("alone", "other")], "hoping": [("hoping", match)], "alone": [("alone", "other")], "context": [("context", match)]}[state]

    return Transducer("begin", arcs, lambda state: state != "hoping")


def aimed(reach: int) -> Transducer:
    """Marks a match as aimed that has a target at most ``reach`` words before or after it. State: words
    for which the last target still reaches, in which a target must come, and in which none may."""

    def arcs(state, symbol):
        if symbol == "quote":
            return [(state, symbol)]
        near, must, never = state
        if symbol == "target":
            return [] if never else [((reach, 0, 0), "other")]
        if must == 1:  # the target that a path hoped for does not come
            return []
        near_, must, never = max(near - 1, 0), max(must - 1, 0), max(never - 1, 0)
        if symbol not in ("insult", "threat"):
            return [((near_, must, never), symbol)]
        what = {"insult": "aimed", "threat": "aimed_threat"}[symbol]
        if near:
            return [((near_, must, never), what)]
        return [((0, must or reach, never), what), ((0, must, reach), symbol)]

    return Transducer((0, 0, 0), arcs, lambda state: not state[1])


def negated(reach: int) -> Transducer:
    """Turns matches into ``negated`` at most ``reach`` words after a negation."""

    def arcs(state, symbol):
        if symbol == "quote":
            return [(state, symbol)]
        if symbol == "negation":
            return [(reach, "other")]
        return [(max(state - 1, 0), "negated" if state and symbol in MATCHES else symbol)]

    return Transducer(0, arcs, lambda state: True)


def reported() -> Transducer:
    """Turns matches into ``reported`` after a verb of speech and between quotation marks."""

    def arcs(state, symbol):
        said, quoted = state
        if symbol == "quote":
            return [((said, not quoted), "other")]
        if symbol == "report":
            return [((True, quoted), "other")]
        return [(state, "reported" if (said or quoted) and symbol in MATCHES else symbol)]

    return Transducer((False, False), arcs, lambda state: True)


def composed(reach: int = REACH) -> Transducer:
    """Insult, threat, target, negation and reported speech, one after the other. Every clause has
    exactly one accepting path."""
    return in_context("insult") @ in_context("threat") @ aimed(reach) @ negated(reach) @ reported()


class Grammar:
    """The composed machine over texts. ``lexicon`` maps insults to weights."""

    def __init__(self, lexicon: dict[str, float]):
        import ahocorasick

        self.symbol: dict[str, tuple[str, float]] = dict.fromkeys("\"“”„«»", ("quote", 0.0))
        for words, kind in ((REPORTS, "report"), (NEGATIONS, "negation"), (TARGETS, "target"), (THREATS, "threat")):
            self.symbol |= {w: (kind, 1.0) for w in words}
        self.symbol |= {w: ("insult", x) for w, x in lexicon.items()}
        self.machine = composed()
        self.find = ahocorasick.Automaton()
        for w, (kind, _) in self.symbol.items():
            if kind in ("insult", "threat"):
                self.find.add_word(w, len(w))
        self.find.make_automaton()

    def clause(self, text: str) -> list[tuple[str, float]]:
        """The matches of one lower-case clause in order: (kind, weight)."""
        read = [self.symbol.get(token, ("other", 0.0)) for token in _TOKEN.findall(text)]
        (found,) = self.machine.paths([kind for kind, _ in read])
        return [("plain" if kind == "insult" else kind, read[i][1]) for i, kind in found if kind in MATCHES or kind in KINDS]

    def features(self, text: str | None) -> list[float]:
        """The logarithm of each kind's matched weight in the text."""
        low = (text or "").lower()
        total = dict.fromkeys(KINDS, 0.0)
        done = 0
        for end, n in self.find.iter(low):
            if end < done or end + 1 < len(low) and low[end + 1].isalnum() or end - n >= 0 and low[end - n].isalnum():
                continue
            start = max(low.rfind(c, done, end) for c in ".!?;:\n") + 1
            m = _CLAUSE_END.search(low, end)
            done = m.start() if m else len(low)
            for kind, weight in self.clause(low[start:done]):
                total[kind] += weight
        return [log1p(total[k]) for k in KINDS]


def held_out(doc: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """At most ``size`` labelled rows outside the held-out fold: (text, toxic), whole texts."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = ids.orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(size)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # size ids at most
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def lexicon(rows: DataFrame, *, strength: float = log(4)) -> dict[str, float]:
    """Words whose lower bound (95 %) of the log-odds of toxic over clean contexts is ``strength`` or
    more, with that bound as weight, and the listed insults."""
    words = F.filter(F.split(F.lower("text"), "[^\\p{L}\\p{N}']+"), lambda w: w != "")
    context = F.transform(F.col("w"), lambda w, i: F.struct(w.alias("word"), F.xxhash64(F.get("w", i - 1), F.get("w", i + 1)).alias("near")))
    each = rows.select(words.alias("w"), "toxic").select("toxic", F.explode(context).alias("x")).select("toxic", "x.word", "x.near").distinct()
    counts = each.groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1)).alias("b"))
    n = rows.agg(F.sum("toxic"), F.count("*")).first()
    bad, good = (n[0] or 0), n[1] - (n[0] or 0)
    found = dict.fromkeys(INSULTS, 1.0)
    if bad and good:
        bound = F.log((F.col("a") + 0.5) / bad) - F.log((F.col("b") + 0.5) / good) - 1.645 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
        found |= {r["word"]: r["x"] for r in counts.where("a >= 3").select("word", bound.alias("x")).where(F.col("x") >= strength).collect()}
    return found


def _fit(x: np.ndarray, y: np.ndarray, pull: float = 1.0) -> list[float]:
    """Logistic regression by Newton's method, pulled towards the starting weights."""
    start = np.array(START)
    w, x = start.copy(), np.hstack([np.ones((len(x), 1)), x])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), x.T @ (p - y) + pull * (w - start))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def _featurise(df: DataFrame, words: dict[str, float], *more: str) -> DataFrame:
    schema = ", ".join([*[f"{c} {dict(df.dtypes)[c]}" for c in more], *[f"{k} double" for k in KINDS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(words)
        for batch in batches:
            if batch.num_rows:
                found = np.array([grammar.features(t.as_py()) for t in batch.column(0)])
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(found[:, i]) for i in range(len(KINDS))]], [*more, *KINDS])

    return df.select("text", *more).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[dict[str, float], list[float]]:
    rows = sample(docs, labels, size)
    words = lexicon(rows)
    got = _featurise(rows, words, "toxic").toPandas()  # at most ``size`` rows of seven numbers
    if not len(got) or got["toxic"].nunique() < 2:
        return words, list(START)
    return words, _fit(got[list(KINDS)].to_numpy(float), got["toxic"].to_numpy(float))


def score(docs: DataFrame, words: dict[str, float], weights: list[float]) -> DataFrame:
    """(doc_id, held_out, score, predicted, and the matched weight of each kind)."""
    found = _featurise(docs.select("text", "doc_id"), words, "doc_id")
    odds = F.lit(weights[0])
    for k, w in zip(KINDS, weights[1:], strict=True):
        odds = odds + F.lit(w) * F.col(k)
    out = found.withColumn("score", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *KINDS)
