"""Personal data by weak supervision (DataFrame functions only).

Candidate spans come from regular expressions. Labelers vote on each candidate: a strict-shape
regex, a gazetteer, the words before it, and its borders. Expectation-maximisation over the votes of
all documents estimates the labelers' reliabilities; its posteriors are the soft labels from which a
final span classifier (naive Bayes over kind, length and votes) is trained. Spans of the four base
kinds always stay; the classifier decides which of the further candidates are added.

Defined results: a null text has no spans. Rows are judged one by one, so repeated rows and null ids
repeat their spans. Empty tables give empty results. Whole texts are read; offsets are code points,
ends exclusive. Other columns stay; one that is named as an added column is replaced, and ``redact``
adds none.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import weak
from .common import between, carrying, cut, cut_up, let, scan, settle

#: Kinds in the order in which spans are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "name", "national_id", "secret")
LABELERS = 4
_SPAN = "array<struct<kind:int,s:int,e:int,base:boolean,votes:array<int>,size:int>>"
_L = "A-Za-z0-9._%+-"

# Base patterns. Lookbehinds and possessive quantifiers only save time: a run of local-part
# characters or digits is tried from its start (or the end of the previous match) alone.
BASE = {
    "email": (f"(?:(?<![{_L}])|\\G)[{_L}]++@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "@"),
    "ip": ("(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", "."),
    "card": ("[0-9]++(?:[\\x20-]?+[0-9]++)*+", None),
    "phone": ("\\+[0-9][\\x20().0-9-]+[0-9]", "+"),
}
# Further candidates: written-out addresses, phone numbers without a plus sign and the like.
MORE = {
    "email": "[A-Za-z0-9._%+-]{1,64}+ ?[\\[({](?i:at)[\\])}] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\\.|[\\[({](?i:dot)[\\])}]) ?[A-Za-z0-9-]{1,63}+){1,8}",
    "phone": "(?<![0-9A-Za-z.+(-])(?:\\([0-9]{2,4}\\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    "iban": "(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "name": "(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Señor|Señora|(?i:my name is|contact person|signed by))[.:]? \\p{Lu}\\p{Ll}{1,30}(?: \\p{Lu}\\p{Ll}{1,30}){0,2}",
    "national_id": "(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "secret": "(?i:password|passwd|pwd|token|secret|api_?key) ?[=:] ?[\"']?[A-Za-z0-9_/+-]{8,}+",
}
# A cheap test that every match of the pattern passes.
HINT = {"email": "[\\[({](?i:at)[\\])}]", "phone": "[0-9]{3}[ .-][0-9]{4}", "iban": "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "name": MORE["name"], "national_id": "[0-9]-[0-9]{2}-[0-9]", "secret": "(?i:passw|pwd|token|secret|api_?key) ?"}
# Gazetteers (fixed values).
TLDS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl"
FIRST_NAMES = "Anna|Maria|John|James|Mary|Robert|Michael|David|Linda|Thomas|Peter|Hans|Klaus|Marie|Jean|Pierre|Juan|Carlos|Jose|Luis|Sarah|Laura|Paul|Daniel|Susan"
CUES = "(?i)(?:e-?mail|mail|contact|write|reach|call|phone|tel|mobile|fax|card|visa|credit|account|iban|ip|server|host|address|name|signed|ssn|id|password|token|key|login|user)[^A-Za-z0-9]{0,3}(?:[A-Za-z]{1,10}[^A-Za-z0-9]{0,3})?$"
AGAINST = "(?i)(?:version|release|page|section|chapter|isbn|figure|table|no\\.|#|\\$|€|v)[^A-Za-z0-9]{0,2}$"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the check of payment cards."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i, 1)) - 48
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike("^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\\.|$)){4}")
    if kind == "card":
        return F.length(_digits(x)).between(16, 19) & _luhn(_digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


def _strict(kind: str, x: Column) -> Column:
    """First labeler: a stricter shape than the candidate's."""
    shape = {
        "email": "^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?:@|[\\[({](?i:at)[\\])}]) ?[A-Za-z0-9].*(?:\\.|[\\])}]) ?[A-Za-z]{2,}$",
        "ip": "^[1-9][0-9]{0,2}(?:\\.(?:0|[1-9][0-9]{0,2})){3}$",
        "card": "^[0-9]{4}([ -]?)[0-9]{4}\\1[0-9]{4}\\1[0-9]{4,7}$",
        "phone": "^\\+?[0-9]{0,3} ?\\(?[0-9]{2,4}\\)?[ .-]?[0-9]{3}[ .-]?[0-9]{2,4}[ .-]?[0-9]{0,4}$",
        "iban": "^[A-Z]{2}[0-9]{2}( ?[0-9]{4}){3}",
        "name": " \\p{Lu}\\p{Ll}+ \\p{Lu}\\p{Ll}+$",
        "national_id": "^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
        "secret": "[0-9]",
    }[kind]
    return F.when(x.rlike(shape), 1).otherwise(-1)


def _known(kind: str, x: Column) -> Column:
    """Second labeler: a gazetteer for the kind; it abstains where there is none."""
    if kind == "email":
        return F.when(x.rlike(f"(?i)[.\\])}}] ?(?:{TLDS})$"), 1).otherwise(-1)
    if kind == "ip":
        return F.when(x.rlike("^(?:0|127|255)\\.|^[0-9]\\.[0-9]\\.[0-9]\\.[0-9]$"), -1).otherwise(1)
    if kind == "card":
        return F.when(x.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"), 1).otherwise(-1)
    if kind == "phone":
        return F.when(x.rlike("^(?:\\+(?:1|3[0-9]|4[0-9])|00[1-9]|\\(?[2-9])"), 1).otherwise(-1)
    if kind == "iban":
        return F.when(x.rlike("^(?:DE|FR|ES|GB|AT|CH|IT|NL|BE)"), 1).otherwise(-1)
    if kind == "name":
        return F.when(x.rlike(f" (?:{FIRST_NAMES})(?: |$)"), 1).otherwise(0)
    return F.lit(0)


def _candidates(t: Column, kind: str, pattern: str, hint: str | None, base: bool) -> Column:
    """Array of spans of one kind. Pieces between matches give the places of the matches."""
    number = F.lit(KINDS.index(kind))
    none = F.array().cast(_SPAN)

    def place(found: Column) -> Column:
        def at(pieces: Column, starts: Column) -> Column:
            def span(m: Column, i: Column) -> Column:
                # context reaches back to the start of the match before, and on to the end of the next
                before = F.right(F.concat(F.when(i > 0, F.get(found, i - 1)).otherwise(""), pieces[i]), F.lit(30))
                after = F.concat(pieces[i + 1], F.coalesce(F.get(found, i + 1), F.lit("")))
                around = F.when(F.concat(F.right(before, F.lit(1)), F.left(after, F.lit(1))).rlike("[A-Za-z0-9]"), -1).otherwise(1)
                votes = F.array(_strict(kind, m), _known(kind, m), F.when(before.rlike(CUES), 1).when(before.rlike(AGAINST), -1).otherwise(0), around)
                s = starts[i] + F.length(pieces[i])
                return F.struct(number.alias("kind"), s.alias("s"), (s + F.length(m)).alias("e"), F.lit(base).alias("base"), votes.alias("votes"), F.length(m).alias("size"), (_valid(kind, m) if base else F.lit(True)).alias("ok"))

            kept = F.filter(F.transform(found, span), lambda x: x["ok"])
            return F.transform(kept, lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "s", "e", "base", "votes", "size")]))

        def walk(pieces: Column) -> Column:
            steps = F.transform(found, lambda m, i: F.length(pieces[i]) + F.length(m))
            return let(scan(steps, F.lit(0), lambda a, x: a + x), lambda starts: at(pieces, starts)).cast(_SPAN)

        return F.when(F.size(found) == 0, none).otherwise(let(F.split(t, pattern), walk))

    test = F.lit(True) if hint is None else t.contains(hint) if base else t.rlike(hint)
    if base and kind in ("ip", "card"):
        test = t.rlike("[0-9]\\.[0-9]++\\.[0-9]" if kind == "ip" else "[0-9](?:[\\x20-]?[0-9]){15}")
    return F.when(test, let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), place)).otherwise(none)


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``found``: base and further candidate spans with their votes, by kind, then start.

    A further candidate that overlaps a base span is left out.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_b", F.concat(*[_candidates(t, k, p, h, True) for k, (p, h) in BASE.items()]))
    df = df.withColumn("_m", F.concat(*[_candidates(t, k, p, HINT[k], False) for k, p in MORE.items()]))
    more = F.when((F.size("_m") == 0) | (F.size("_b") == 0), F.col("_m")).otherwise(_apart(F.col("_m"), F.col("_b")))
    return settle(df.withColumn("found", F.sort_array(F.concat("_b", more))).drop("_b", "_m"), "found")


def _apart(more: Column, base: Column) -> Column:
    """The spans of ``more`` that overlap none of ``base``: by start, the ends of base spans so far and
    the start of the next base span are carried along."""
    far = F.lit(2**31 - 1)
    by_start = F.sort_array(F.transform(F.concat(base, more), lambda x: F.struct(x["s"].alias("s"), (~x["base"]).alias("extra"), x.alias("x"))))

    def sweep(xs: Column) -> Column:
        ends = scan(F.transform(xs, lambda y: F.when(y["extra"], 0).otherwise(y["x"]["e"])), F.lit(0), F.greatest)
        nexts = F.reverse(scan(F.reverse(F.transform(xs, lambda y: F.when(y["extra"], far).otherwise(y["s"]))), far, F.least))
        seen = F.zip_with(F.arrays_zip(xs.alias("y"), ends.alias("end")), nexts, lambda a, n: F.struct(a["y"]["x"].alias("x"), (a["y"]["extra"] & (a["end"] <= a["y"]["s"]) & (n >= a["y"]["x"]["e"])).alias("ok")))
        return F.transform(F.filter(seen, lambda a: a["ok"]), lambda a: a["x"])

    return let(by_start, sweep)


def train(found: DataFrame, *, rounds: int = 25) -> Column:
    """Fit the labelers' reliabilities and the span classifier on all ``found``; returns a function
    from a span to its probability of being personal data."""
    spans = found.select(F.explode("found").alias("x")).select("x.*")
    model = weak.fit(spans, "votes", LABELERS, prior=0.7, start=(0.8, 0.05, 0.3, 0.5), rounds=rounds)
    soft = spans.groupBy("kind", "size", "votes").agg(F.count("*").alias("n"))
    soft = soft.withColumn("y", weak.posterior(model, "votes"))
    feature = F.explode(F.array(F.concat(F.lit("kind"), F.col("kind")), F.concat(F.lit("size"), _bucket(F.col("size"))), *[F.concat(F.lit(f"v{k}:"), F.col("votes")[k]) for k in range(LABELERS)], F.lit("all")))
    # at most 8 kinds, 8 sizes and 12 votes: a table of fixed size
    table = {r["f"]: (r["a"], r["b"]) for r in soft.select(feature.alias("f"), (F.col("n") * F.col("y")).alias("y"), (F.col("n") * (1 - F.col("y"))).alias("z")).groupBy("f").agg(F.sum("y").alias("a"), F.sum("z").alias("b")).collect()}
    up, down = table.get("all", (0.0, 0.0))
    weights = {f: log((a + 1) / (up + 2)) - log((b + 1) / (down + 2)) for f, (a, b) in table.items() if f != "all"}
    prior = log((up + 1) / (down + 1))

    def lookup(key: Column) -> Column:
        if not weights:
            return F.lit(0.0)
        return F.coalesce(F.create_map(*[F.lit(v) for kv in sorted(weights.items()) for v in kv])[key], F.lit(0.0))

    def score(x: Column) -> Column:
        odds = F.lit(prior) + lookup(F.concat(F.lit("kind"), x["kind"])) + lookup(F.concat(F.lit("size"), _bucket(x["size"])))
        for k in range(LABELERS):
            odds = odds + lookup(F.concat(F.lit(f"v{k}:"), x["votes"][k]))
        return 1 / (1 + F.exp(-odds))

    return score


def _bucket(size: Column) -> Column:
    return F.least(F.floor(size / 5), F.lit(7)).cast("string")


def detect(df: DataFrame, text: str = "text", *, keep_text: bool = True, threshold: float = 0.5) -> DataFrame:
    """Add ``spans``, an array of (kind, s, e, base, p): all base spans and the candidates that the
    classifier gives ``threshold`` or more, by kind, then start.

    Without ``keep_text`` the texts are read once and only spans are checkpointed; with it they are
    read once for the fit and once for the result.
    """

    def work(rows: DataFrame) -> DataFrame:
        return _detect(rows, text, keep_text, threshold)

    return carrying(df, [text], ["spans"], work, () if keep_text else (text,))


def _detect(df: DataFrame, text: str, keep_text: bool, threshold: float) -> DataFrame:
    found = find(df, text)
    if not keep_text:
        found = cut(found.drop(text))
    score = train(found.select("found"))
    scored = F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base"), score(x).alias("p")))
    return found.withColumn("spans", F.filter(scored, lambda x: x["base"] | (x["p"] >= threshold))).drop("found")


def name_of(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name_of(x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace every detected span in ``text`` by ``<KIND>``; overlapping spans are joined under the
    first one's kind. Null texts stay null; other columns are unchanged."""
    return carrying(df, [text], [text], lambda rows: _redact(rows, text)).select(*[F.col(f"`{c}`") for c in df.columns])


def _redact(df: DataFrame, text: str) -> DataFrame:
    out = _detect(df, text, True, 0.5)
    t = F.col(text)
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))

    def parts_of(spans: Column) -> Column:
        ends = scan(F.transform(spans, lambda x: x["e"]), F.lit(0), F.greatest)
        marked = F.filter(F.zip_with(spans, ends, lambda x, at: F.struct(x.alias("x"), at.alias("at"))), lambda y: y["x"]["s"] >= y["at"])
        last = F.array_max(F.transform(spans, lambda x: x["e"]))

        def text_of(blocks: Column) -> Column:
            said = F.transform(marked, lambda y: F.concat(between(blocks, y["at"], y["x"]["s"]), F.lit("<"), F.upper(name_of(y["x"]["kind"])), F.lit(">")))
            return F.concat(F.array_join(said, ""), between(blocks, last, F.length(t)))

        return let(cut_up(t), text_of)

    return out.withColumn(text, F.when(F.size("spans") > 0, let(ordered, parts_of)).otherwise(t)).drop("spans")
