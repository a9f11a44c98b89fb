"""Personal data by weak supervision, with built-in functions only.

Base patterns find e-mail addresses, IP addresses, payment cards and phone numbers; each match
that passes its check is a span. Wider patterns find candidates in other notations (obfuscated
addresses, phone numbers without a plus sign, account numbers, names after a title). Labelers of
three kinds vote on every candidate of the corpus, base matches included, for or against it or not
at all: **regex** labelers look at its form, **gazetteer** labelers for known parts, **context**
labelers at the words before it. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is, and the posteriors train a logistic classifier of spans on
votes and form. Candidates that it accepts and that touch no base span are added.

Only the counts of distinct patterns reach the driver: at most (candidate kinds) * 3^(labelers) *
(shapes) rows, whatever the corpus holds. The model is a few dozen numbers, compiled into the
projection that scores the candidates.

Defined results: a null text is empty and has no spans; repeated rows get the same spans; offsets
are code points, the end exclusive; other columns stay; an empty table gives an empty table and a
model that accepts nothing. A column named ``spans`` is replaced.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .text import let, running_sums, whole

# Base patterns. A match starts at the start of a run or at the end of the match before: other
# starts inside a run can't match either, and trying them takes time in the square of a long run.
# Possessive repeats match the same here, since nothing after them could use a character given back.
_LOCAL = "[A-Za-z0-9._%+-]"
_EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
BASE = ("email", "ip", "card", "phone")

#: Kinds of spans in the order in which they are listed.
KINDS = (*BASE, "account", "name")

# Candidates in other notations: kind, what a text must hold to be searched, pattern.
CANDIDATES = (
    ("email", r"(?i)[(\[{]\s?at\s?[)\]}]",
     r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{1,64}\s?[(\[{]\s?at\s?[)\]}]\s?[a-z0-9-]{1,63}(?:\s?(?:[(\[{]\s?dot\s?[)\]}]|\.)\s?[a-z0-9-]{1,63}){1,4}"),
    # What the pattern needs in every match.
    ("phone", r"[0-9]{2}(?:\)\x20?|[\x20./-])[0-9]{3,5}[\x20.-]?[0-9]{3}",
     r"(?<![0-9+.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{3,5}[\x20.-]?[0-9]{3,5}(?![0-9.-])"),
    ("account", r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("name", r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora)\b",
     r"(?<=\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora)\.?\x20)\p{Lu}\p{Ll}{1,20}(?:\x20\p{Lu}\p{Ll}{1,20}){0,2}"),
)

#: Words before a span that speak for each kind, and known parts. Fixed values.
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\W{0,3}(?:\w{1,9}\W{1,3}){0,2}$",
    "phone": r"(?i)(?:phone|tel|telefon|téléphone|teléfono|call|mobile|fax|handy|cell)\W{0,3}(?:\w{1,9}\W{1,3}){0,2}$",
    "account": r"(?i)(?:iban|account|konto|compte|cuenta)\W{0,3}(?:\w{1,9}\W{1,3}){0,2}$",
    "name": r"(?i)(?:dear|from|by|with|named?|signed|liebe[r]?|cher|chère)\W{0,3}(?:\w{1,9}\W{1,3}){0,1}$",
}
AGAINST = r"(?i)(?:version|page|order|invoice|chapter|isbn|id|no|nr|\$|€|=|:)\W{0,2}$"
GAZETTEER = {
    "email": r"(?i)(?:\.|dot\s?[)\]}]\s?)(?:com|org|net|edu|gov|de|fr|es|io|info)$",
    "phone": r"^(?:\(?0|\(?[2-9][0-9]{2}\)?[\x20.-]?[2-9][0-9]{2}[\x20.-]?[0-9]{4}$)",
    "account": r"^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|RO|SE|SI|SK)",
    "name": r"^(?:James|John|Mary|Anna|Peter|Paul|Maria|Hans|Pierre|Marie|Jean|José|Juan|Carmen|Thomas|Sarah|David|Michael|Julia|Laura)\b",
}
FORM = {
    "email": r"(?i)[(\[{]\s?at\s?[)\]}].*(?:dot\s?[)\]}]|\.)",
    "phone": r"^\([0-9]{3}\)\x20?[0-9]{3}[\x20-][0-9]{4}$|^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$",
    "account": r"^[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4})+(?:\x20[A-Z0-9]{1,3})?$|^[A-Z]{2}[0-9]{13,30}$",
    "name": r"^\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}+",
}
LABELERS = ("form", "gazetteer", "context", "against", "base")
SPAN = "array<struct<kind:string,start:bigint,end:bigint,s:string,before:string>>"
_CONTEXT_CHARS = 40


def matches(text: Column, kind: str, pattern: str) -> Column:
    """Leftmost matches that do not overlap: their text, code point offsets and the text before.

    The pieces between matches are what ``split`` leaves, so offsets are sums of lengths.
    """
    def placed(m, pieces):
        sums = running_sums_of(m, pieces)
        return let(sums, lambda ends: F.transform(m, lambda s, i: F.struct(
            F.lit(kind).alias("kind"), (F.get(ends, i) - F.length(s)).alias("start"), F.get(ends, i).alias("end"),
            s.alias("s"), F.right(F.get(pieces, i), F.lit(_CONTEXT_CHARS)).alias("before"))))

    def running_sums_of(m, pieces):
        return let(F.transform(m, lambda s, i: F.length(F.get(pieces, i)) + F.length(s)), running_sums)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: F.when(
        F.size(m) > 0, let(F.split(text, pattern, -1), lambda pieces: placed(m, pieces))).otherwise(F.array().cast(SPAN)))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the base kinds that pass their checks, in order of start."""
    digits = lambda x: F.regexp_replace(x["s"], "[^0-9]", "")
    checks = {
        "email": (F.contains(text, F.lit("@")), _EMAIL, None),
        "ip": (F.contains(text, F.lit(".")), _IP, lambda x: x["s"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
        "card": (None, _CARD, lambda x: F.length(digits(x)).between(13, 19) & F.call_function("luhn_check", digits(x))),
        "phone": (F.contains(text, F.lit("+")), _PHONE, lambda x: F.length(digits(x)).between(9, 15)),
    }
    out = {}
    for kind, (needed, pattern, check) in checks.items():
        found = matches(text, kind, pattern)
        if check is not None:
            found = F.filter(found, check)
        out[kind] = found if needed is None else F.when(needed, found).otherwise(F.array().cast(SPAN))
    return out


def candidate_spans(text: Column) -> Column:
    none = F.array().cast(SPAN)
    return F.concat(*[F.when(text.rlike(needed), matches(text, kind, pattern)).otherwise(none)
                      for kind, needed, pattern in CANDIDATES])


def _by_kind(x: Column, table: dict[str, str]) -> Column:
    test = F.lit(False)
    for kind, pattern in table.items():
        subject = x["before"] if table is CONTEXT else x["s"]
        test = F.when(x["kind"] == kind, subject.rlike(pattern)).otherwise(test)
    return test


def votes(x: Column, is_base: bool) -> dict[str, Column]:
    """1 for, -1 against, 0 no vote."""
    vote = lambda yes, no=None: F.when(yes, 1).otherwise(0 if no is None else F.when(no, -1).otherwise(0))
    if is_base:
        form, gazetteer = F.lit(1), vote((x["kind"] == "email") & x["s"].rlike(GAZETTEER["email"]))
    else:
        form, gazetteer = F.when(_by_kind(x, FORM), 1).otherwise(-1), F.when(_by_kind(x, GAZETTEER), 1).otherwise(-1)
    return {"form": form, "gazetteer": gazetteer, "context": vote(_by_kind(x, CONTEXT)),
            "against": vote(F.lit(False), x["before"].rlike(AGAINST)), "base": F.lit(1 if is_base else 0)}


def shape(x: Column) -> Column:
    """Length and mark-up of a span in four classes each."""
    return (F.least(F.lit(3), F.floor(F.length(x["s"]) / 8)) * 4
            + F.least(F.lit(3), F.length(F.regexp_replace(x["s"], r"[\p{L}0-9]", "")))).cast("int")


@dataclass(frozen=True)
class Model:
    """Weights of the span classifier; ``reliability`` of each labeler: P(for | true), P(for | false),
    P(against | true), P(against | false)."""
    weights: tuple[tuple[str, float], ...]
    reliability: tuple[tuple[str, tuple[float, float, float, float]], ...]

    def accepts(self, x: Column, threshold: float = 0.9) -> Column:
        w = dict(self.weights)
        score = F.lit(w.get("bias", -9.0))
        for name, vote in votes(x, False).items():
            score = score + F.when(vote == 1, w.get(f"{name}+", 0.0)).when(vote == -1, w.get(f"{name}-", 0.0)).otherwise(0.0)
        for value in range(16):
            if f"shape{value}" in w:
                score = score + F.when(shape(x) == value, w[f"shape{value}"]).otherwise(0.0)
        return score >= math.log(threshold / (1 - threshold))


def patterns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of the distinct patterns of votes and shapes over all candidates of all documents."""
    t = whole(f"`{text}`")
    def rows(spans, is_base):
        return F.transform(spans, lambda x: F.struct(*[v.alias(n) for n, v in votes(x, is_base).items()], shape(x).alias("shape")))
    base = F.concat(*base_spans(t).values())
    found = docs.select(F.explode(F.concat(rows(base, True), rows(candidate_spans(t), False))).alias("_p"))
    return found.select("_p.*").groupBy(*LABELERS, "shape").agg(F.count(F.lit(1)).alias("n"))


def fit(docs: DataFrame, text: str = "text", rounds: int = 50) -> Model:
    """Estimates the labelers' reliabilities and trains the classifier over all of ``docs``."""
    rows = sorted((tuple(r[c] for c in LABELERS), r["shape"], r["n"]) for r in patterns(docs, text).collect())
    return fit_patterns(rows, rounds)


def fit_patterns(rows: list[tuple[tuple[int, ...], int, int]], rounds: int = 50) -> Model:
    if not rows:
        return Model((), ())
    total = sum(n for *_, n in rows)
    # Labelers start as better than chance; base matches passed a check and stand as known.
    p = {j: [0.7, 0.2, 0.1, 0.4] for j in range(len(LABELERS))}
    prior, base = 0.5, LABELERS.index("base")
    post = []
    for _ in range(rounds):
        post = []
        for v, _, _ in rows:
            if v[base] == 1:
                post.append(1.0)
                continue
            yes, no = math.log(prior), math.log(1 - prior)
            for j, x in enumerate(v):
                if j != base:
                    a, b, c, d = p[j]
                    yes += math.log({1: a, -1: c, 0: 1 - a - c}[x])
                    no += math.log({1: b, -1: d, 0: 1 - b - d}[x])
            post.append(1 / (1 + math.exp(min(50.0, no - yes))))
        true = sum(q * n for q, (*_, n) in zip(post, rows))
        prior = min(0.95, max(0.05, true / total))
        for j in range(len(LABELERS)):
            def rate(side, value):
                # Smoothed towards the start, so that a labeler without votes stays as it was.
                seen = sum((q if side else 1 - q) * n for q, (v, _, n) in zip(post, rows) if v[j] == value)
                start = {(1, 1): 0.7, (0, 1): 0.2, (1, -1): 0.1, (0, -1): 0.4}[(side, value)]
                return (seen + 10 * start) / ((true if side else total - true) + 10)
            p[j] = [min(0.9, max(0.02, x)) for x in (rate(1, 1), rate(0, 1), rate(1, -1), rate(0, -1))]
            for a in (0, 1):
                if p[j][a] + p[j][a + 2] > 0.97:
                    s = 0.97 / (p[j][a] + p[j][a + 2])
                    p[j][a], p[j][a + 2] = p[j][a] * s, p[j][a + 2] * s
    # The classifier: logistic regression on the posteriors, without the vote that only base
    # matches can have.
    names = ["bias"] + [f"{x}{s}" for x in LABELERS if x != "base" for s in "+-"] + [f"shape{i}" for i in range(16)]
    at = {n: i for i, n in enumerate(names)}
    data = []
    for q, (v, s, n) in zip(post, rows):
        on = [0, at[f"shape{s}"]] + [at[f"{x}{'+' if y > 0 else '-'}"] for x, y in zip(LABELERS, v) if x != "base" and y]
        data.append((on, q, n / total))
    w = [0.0] * len(names)
    for _ in range(2000):
        grad = [1e-3 * x for x in w]
        for on, q, n in data:
            d = n * (1 / (1 + math.exp(-max(-50.0, min(50.0, sum(w[i] for i in on))))) - q)
            for i in on:
                grad[i] += d
        w = [x - 1.0 * g for x, g in zip(w, grad)]
    return Model(tuple(zip(names, w)), tuple((LABELERS[j], tuple(p[j])) for j in range(len(LABELERS))))


def find_spans(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: arrays of (kind, start, end), ``base`` and ``added``, in order of kind and start."""
    t = whole(f"`{text}`")
    found = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "spans"],
                        F.explode(F.array(F.struct(F.concat(*base_spans(t).values()).alias("base"),
                                                   candidate_spans(t).alias("wide")))).alias("_s"))
    apart = lambda x: ~F.exists(F.col("_s.base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    added = F.filter(F.filter(F.col("_s.wide"), lambda x: model.accepts(x)), apart)
    bare = lambda spans: F.transform(spans, lambda x: F.struct(x["kind"], x["start"], x["end"]))
    return (found.withColumn("_added", added)
            .withColumn("spans", F.struct(bare(F.col("_s.base")).alias("base"), bare(F.col("_added")).alias("added")))
            .drop("_s", "_added"))


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """Labels, fits and finds: ``docs`` with their ``spans``."""
    return find_spans(docs, fit(docs, text), text)


def rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def in_order(spans: Column) -> Column:
    """Spans by kind as listed, then start."""
    keyed = F.sort_array(F.transform(spans, lambda x: F.struct(
        rank(x["kind"]).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.transform(keyed, lambda x: F.struct(x["kind"], x["start"], x["end"]))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _running_max(values: Column, block: int = 256) -> Column:
    """Largest of the first 1, 2, ... elements of an array that is cheap to refer to; blocks bound the work per element."""
    n_blocks = F.ceil(F.size(values) / block).cast("int")
    tops = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda j: F.array_max(F.slice(values, j * block + 1, block)))

    def reach(tops):
        of_block = lambda i: F.floor(i / block).cast("int")
        return F.transform(F.sequence(F.lit(0), F.size(values) - 1), lambda i: F.greatest(
            F.array_max(F.slice(tops, F.lit(1), of_block(i))), F.array_max(F.slice(values, of_block(i) * block + 1, i % block + 1))))
    return let(tops, reach)


def _cuts(spans: Column) -> Column:
    """Spans in order of their start, those that overlap as one, named after the first."""
    def with_reach(ends):
        return let(_running_max(ends), lambda reach: let(
            F.filter(F.sequence(F.lit(0), F.size(reach) - 1), lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(reach, i - 1))),
            lambda first: F.transform(first, lambda f, k: F.struct(
                F.get(spans, f)["start"].alias("start"),
                F.get(reach, F.coalesce(F.get(first, k + 1), F.size(reach)) - 1).alias("end"), F.get(spans, f)["kind"].alias("kind")))))
    return let(F.transform(spans, lambda x: x["end"]), with_reach)


def _replaced(text: Column, cuts: Column, block: int = 256) -> Column:
    """``text`` with each cut replaced. A substring counts characters from the begin of its string, so the text is first
    divided into stretches of ``block`` cuts."""
    end_before = lambda k: F.when(k > 0, F.get(cuts, k - 1)["end"]).otherwise(0)
    piece = lambda t, a, b: F.substring(t, (a + 1).cast("int"), (b - a).cast("int"))

    def stretch(j):
        part, origin = F.slice(cuts, j * block + 1, block), end_before(j * block)
        return let(F.struct(piece(text, origin, F.element_at(part, -1)["end"]).alias("t"), part.alias("p"), origin.alias("o")), lambda s: F.array_join(
            F.transform(s["p"], lambda c, i: F.concat(
                piece(s["t"], F.when(i > 0, F.get(s["p"], i - 1)["end"]).otherwise(s["o"]) - s["o"], c["start"] - s["o"]),
                F.lit("["), F.upper(c["kind"]), F.lit("]"))), ""))
    n = F.ceil(F.size(cuts) / block).cast("int")
    tail = F.substring(text, (end_before(F.size(cuts)) + 1).cast("int"), F.length(text))
    return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), stretch), ""), tail)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets. Spans that overlap are replaced as
    one, named after the first. ``n_chars`` follows the text; other columns, of any name, stay as they are."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.col(f"`{text}`").alias("text"))
    in_place = F.sort_array(F.transform(F.concat("spans.base", "spans.added"), lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    found = detect(rows).withColumn("in_place", in_place)
    some = F.size("in_place") > 0
    new = F.when(some, let(F.col("in_place"), lambda s: let(_cuts(s), lambda cuts: _replaced(F.col("text"), cuts))))
    found = found.select("record", some.alias("some"), F.explode(F.array(new)).alias("new"))
    old = lambda c: F.col("record")[c]
    changed = {text: F.col("new")} | ({"n_chars": F.length("new").cast("long")} if "n_chars" in docs.columns else {})
    return found.select(*[(F.when(F.col("some"), changed[c]).otherwise(old(c)) if c in changed else old(c)).alias(c) for c in docs.columns])
