"""Quality rules: a table of thresholds compiled into one projection.

Every rule compares two measures of a text in whole numbers, so that Spark and plain SQL decide
alike. Only built-in functions run; a text is judged alone, without any shuffle.

Defined results: a null text has no words and fails; an empty text likewise; repeated rows are
judged alike; other columns stay as they are; an empty table gives an empty table.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .text import WORD, let, whole, words

#: Frequent function words of four languages. Fixed values.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "have", "he",
    "in", "is", "it", "not", "of", "on", "or", "she", "that", "the", "they", "this", "to", "was",
    "were", "with", "you",
    "als", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "einen", "im", "ist",
    "mit", "nicht", "sich", "und", "von", "zu", "für",
    "au", "aux", "avec", "ce", "dans", "de", "du", "en", "est", "et", "il", "la", "le", "les",
    "ne", "pas", "pour", "qui", "sur", "un", "une",
    "con", "del", "el", "los", "las", "no", "para", "por", "que", "se", "su", "y",
)


@dataclass(frozen=True)
class Rule:
    """A text fails when ``scale * measure`` is above (or below) ``bound * per``.

    ``measure`` and ``per`` name columns of ``measures``; ``per`` may be ``one``.
    """
    name: str
    measure: str
    sign: str
    bound: int
    per: str = "one"
    scale: int = 1

    def fails(self) -> str:
        return f"{self.scale} * {self.measure} {self.sign} {self.bound} * {self.per}"


#: The base rules come first; the rest is the method's own verdict.
BASE_RULES = (
    Rule("too_short", "n_words", "<", 10),
    Rule("repeated_words", "n_repeat_words", ">", 20, "n_words", 100),
)
RULES = (
    Rule("short_words", "word_chars", "<", 2, "n_words"),
    Rule("long_words", "word_chars", ">", 15, "n_words"),
    Rule("symbols", "n_symbols", ">", 15, "n_words", 100),
    Rule("repeated_lines", "n_dup_lines", ">", 50, "n_lines", 100),
    Rule("few_stop_words", "n_stop_words", "<", 3, "n_later_words", 100),
    Rule("shouting", "n_upper", ">", 40, "word_chars", 100),
    Rule("exclamation", "n_exclamation", ">", 30, "n_words", 100),
    Rule("bullets", "n_bullet_lines", ">", 90, "n_lines", 100),
    Rule("ellipsis", "n_ellipsis_lines", ">", 30, "n_lines", 100),
)


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


_PLACE_BITS = 30  # a string holds fewer words than 2^30


def repeated_words(w: Column, width: int) -> Column:
    """Words that lie in windows of ``width`` words found twice or more. ``w`` is cheap to refer to.

    Windows meet by sorting the upper bits of their hashes with their places below; windows of equal
    bits are compared word by word. In the rare case that two different ones have equal bits, whole
    windows are sorted instead.
    """
    window = lambda i: F.slice(w, i + 1, width)

    def covered(places):
        return let(F.sort_array(places), lambda p: F.aggregate(
            F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"),
            lambda n, i: n + F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - F.get(p, i), F.lit(width)))))

    def neighbours(s, same, place):
        each = F.sequence(F.lit(0), F.size(s) - 1)
        return F.transform(F.filter(each, lambda k: same(k, k - 1) | same(k, k + 1)), lambda k: place(k).cast("int"))

    def by_bits(s):
        bits = lambda k: F.shiftright(F.get(s, k), _PLACE_BITS)
        place = lambda k: (F.get(s, k) % (1 << _PLACE_BITS) + (1 << _PLACE_BITS)) % (1 << _PLACE_BITS)
        same = lambda a, b: F.coalesce(bits(a) == bits(b), F.lit(False))
        clash = F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda k: same(k, k - 1) & (
            window(place(k).cast("int")) != window(place(k - 1).cast("int"))))
        return F.when(clash, by_windows()).otherwise(covered(neighbours(s, same, place)))

    def by_windows():
        keyed = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.struct(
            window(i).alias("w"), i.alias("at"))))
        return let(keyed, lambda s: covered(neighbours(
            s, lambda a, b: F.coalesce(F.get(s, a)["w"] == F.get(s, b)["w"], F.lit(False)), lambda k: F.get(s, k)["at"])))

    def of_hashes(h):
        packed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(F.shiftright(x, _PLACE_BITS), _PLACE_BITS) + i))
        # Most texts repeat no window, which their hashes alone show.
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(packed, by_bits)).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - width),
                         lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
    return F.when(F.size(w) >= width, let(hashes, of_hashes)).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """A struct of all measures of a text."""
    def of(w, lines):
        return F.struct(*[x.cast("long").alias(name) for name, x in (
            ("n_words", F.size(w)),
            ("word_chars", F.length(F.array_join(w, ""))),
            ("n_symbols", _without(text, "[#*$%&|<>]")),
            ("n_lines", F.size(lines)),
            ("n_dup_lines", F.size(lines) - F.size(F.array_distinct(lines))),
            ("n_repeat_words", repeated_words(w, 5)),
            ("n_stop_words", F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS)))),
            # A short text may do without.
            ("n_later_words", F.greatest(F.size(w) - 20, F.lit(0))),
            ("n_upper", _without(text, "[A-Z]")),
            ("n_exclamation", F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))),
            ("n_bullet_lines", F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]\s")))),
            ("n_ellipsis_lines", F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$")))),
        )])
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return let(words(text), lambda w: let(lines, lambda x: of(w, x)))


def judge(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """``docs`` with the column ``quality``: the measures, ``base_failed``, ``failed`` (names of the
    rules that a text breaks) and ``kept``. A column of that name is replaced."""
    measured = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "quality"],
                           F.explode(F.array(measures(whole(f"`{text}`")))).alias("_m"))
    def fails(rule):
        # A backquoted struct field is what a rule's column names stand for.
        expr = f"{rule.scale} * _m.{rule.measure} {rule.sign} {rule.bound}" + ("" if rule.per == "one" else f" * _m.{rule.per}")
        return F.expr(expr)
    base = F.expr("false")
    for rule in BASE_RULES:
        base = base | fails(rule)
    failed = F.filter(F.array(*[F.when(fails(r), F.lit(r.name)) for r in (*BASE_RULES, *rules)]), lambda x: x.isNotNull())
    return (measured.withColumn("_failed", failed)
            .withColumn("quality", F.struct("_m.*", base.alias("base_failed"), F.col("_failed").alias("failed"),
                                            (F.size("_failed") == 0).alias("kept")))
            .drop("_m", "_failed"))


def oracle_sql(rules=RULES) -> str:
    """The same judgement as plain SQL over ``documents``."""
    def sql(rule):
        return rule.fails().replace(" * one", "")
    base = " or ".join(f"({sql(r)})" for r in BASE_RULES)
    own = " or ".join(f"({sql(r)})" for r in rules)
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
windows as (select doc_id, i, w[i:i + 4] as g from w, unnest(range(1, len(w) - 3)) as r(i)),
again as (select doc_id, unnest(range(i, i + 5)) as p from windows
          qualify count(*) over (partition by doc_id, g) > 1),
covered as (select doc_id, count(distinct p) as n from again group by doc_id),
m as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
      len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
      coalesce(covered.n, 0)::bigint as n_repeat_words,
      len(list_filter(w, lambda x: lower(x) in ({stop})))::bigint as n_stop_words,
      greatest(len(w) - 20, 0)::bigint as n_later_words,
      (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::bigint as n_upper,
      (length(text) - length(replace(text, '!', '')))::bigint as n_exclamation,
      len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*\x{{2022}}]\s')))::bigint as n_bullet_lines,
      len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})\s*$')))::bigint as n_ellipsis_lines
      from w left join covered using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({base}) as base_failed, not (({base}) or {own}) as kept from m"""
