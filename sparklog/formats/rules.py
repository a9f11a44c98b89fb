"""Formats that users describe by rules: where a record starts and ends, and its fields."""

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.levels import parse_level
from ..functions.times import parse_timestamp
from ..operators.ahead import with_lines_ahead
from ..operators.blocks import glue_records, index_blocks
from ..sources.files import scan_units
from .common import apply_malformed_policy, strip_cr, to_records, with_once

# The record fields a rule may fill.
SLOTS = ("timestamp", "level", "logger", "thread", "message", "exception")
# Only \n ends a line.
_DIALECT = "(?d)"
_LOOKS_BEHIND = re.compile(r"\(\?<[=!][^)]*(?:\\[nR]|\n)")
# A line break that a pattern asks for by itself: outside of sets and of what is to be absent.
_BREAK = re.compile(r"(?:(?<=[^\\])|^)(?:\\\\)*(?:\\[nR]|\n)(?![^\[\]]*\])")


@dataclass(frozen=True)
class FieldRule:
    """Fill ``slot`` with a match in the text that is still unread.

    Rules without any states act once each, in their order. Where rules have states, the text is
    scanned: of the rules that act in the current state the one whose match begins first is taken,
    of those the longest, of those the first in the list; it fills its slot (again, if need be) and
    moves on to ``state_to``, until none matches. A rule acts in the states of ``state_from``, one
    name or several, or in all. The first state is INITIAL.
    """

    slot: str
    pattern: str
    group: int = 0
    state_from: str | tuple[str, ...] | None = None
    state_to: str | None = None

    @property
    def states(self) -> tuple[str, ...]:
        """The states in which the rule acts; none for all."""
        return (self.state_from,) if isinstance(self.state_from, str) else tuple(self.state_from or ())


@dataclass(frozen=True)
class RuleSet:
    """``start`` opens a record at each of its matches in a line; it may look at the text around it in that line.
    ``end`` (not part of the record) closes it; without ``end`` a record lasts until the next start. An end is looked
    for from the start on and lies in one line, its break included. ``definitions`` are named patterns, used as
    ``{name}`` in all others.

    A start that goes on in the lines behind its own needs ``start_lines``, the lines that it takes at most, its own
    included; a pattern with a line break is refused without. Starts are then looked for from the begin of each line,
    in its text and the lines behind it, and those that begin in the line, or with its break, count. A line at the
    end of a file counts as ended by a break. Matches may not overlap, and can't look back over a line break.
    """

    name: str
    start: str
    end: str | None = None
    fields: tuple[FieldRule, ...] = ()
    timestamp_format: str | None = None
    definitions: dict[str, str] = field(default_factory=dict)
    start_lines: int = 1

    def __post_init__(self):
        unknown = [f.slot for f in self.fields if f.slot not in SLOTS]
        if unknown:
            raise ValueError(f"unknown slots {unknown}; use {SLOTS}")
        for pattern in (self.start, self.end or "", *[f.pattern for f in self.fields]):
            self.expand(pattern)
        if self.start_lines < 1:
            raise ValueError("a start takes one line or more")
        if self.start_lines == 1 and _BREAK.search(self.expand(self.start)):
            raise ValueError("a start with a line break needs start_lines, the lines it takes at most")
        if _LOOKS_BEHIND.search(self.expand(self.start)):
            raise ValueError("a start can't look back over a line break")

    def expand(self, pattern: str) -> str:
        """Replace ``{name}`` by its definition; repetition counts such as ``{2}`` stay."""
        def replace(match, open_names=()):
            name = match.group(1)
            if name in open_names:
                raise ValueError(f"definition {name} refers to itself")
            if name not in self.definitions:
                raise ValueError(f"no definition for {{{name}}}")
            inner = re.sub(r"\{([A-Za-z_]\w*)\}", lambda m: replace(m, (*open_names, name)),
                           self.definitions[name])
            return f"(?:{inner})"
        return re.sub(r"\{([A-Za-z_]\w*)\}", replace, pattern)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "RuleSet":
        value = json.loads(text)
        value["fields"] = tuple(FieldRule(**{**f, "state_from": tuple(f["state_from"]) if isinstance(
            f["state_from"], list) else f["state_from"]}) for f in value["fields"])
        return cls(**value)


def _regex(rules: RuleSet, pattern: str) -> Column:
    return F.lit(_DIALECT + rules.expand(pattern))


def _let(value: Column, use) -> Column:
    """Name a value inside of an expression, so that it is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


#: Characters that no text should hold; they mark the places of matches.
_STOP, _FILL = "\ufdd1", "\ufdd0"


def _pieces(text: Column, pattern: str, ahead: Column | None = None) -> Column:
    """A text cut in front of every match: what is before the first one, if only nothing, and then the
    matches, each with the text up to the next one.

    Every match is found in the whole text, so patterns may look around and may match nothing. A text that
    holds the filling character gets a mark with a longer run of it than any text of that length has. With
    ``ahead`` the text is one line, matched with the lines behind it; the pieces are those of the line.
    """
    whole = text if ahead is None else F.concat(text, F.lit("\n"), ahead)
    fill = F.when(F.contains(whole, F.lit(_FILL)), F.length(whole) + 1).otherwise(F.lit(1))
    mark = F.concat(F.lit(_STOP), F.repeat(F.lit(_FILL), fill), F.lit(_STOP))

    def cut(m):
        marked = F.regexp_replace(whole, F.lit(pattern), F.concat(m, F.lit("$0")))
        return F.split(marked if ahead is None else F.substring_index(marked, "\n", 1), m, -1)

    return _let(mark, cut)


def _start_pattern(rules: RuleSet) -> str:
    # A text of several lines is matched as its lines would be.
    return "(?dm)" + rules.expand(rules.start)


def rule_texts(text: Column, rules: RuleSet) -> Column:
    """The records of a whole text, for instance of one message."""
    begun = _let(_pieces(text, _start_pattern(rules)), lambda p: F.slice(p, F.lit(2), F.size(p)))
    if rules.end:
        return F.transform(begun, lambda x: _let(
            F.regexp_instr(x, _regex(rules, rules.end)),
            lambda at: F.when(at > 0, F.substr(x, F.lit(1), at - 1)).otherwise(x)))
    return F.transform(begun, lambda x: F.regexp_replace(x, r"\r?\n\z", ""))


def split_lines(units: DataFrame, rules: RuleSet) -> DataFrame:
    """Lines with ``start``; those that hold several starts, or text before one, become several units."""
    start = rules.expand(rules.start)
    ahead = None
    others = [c for c in units.columns if c not in ("value", "width")]
    if rules.start_lines > 1:
        units, ahead = with_lines_ahead(units, rules.start_lines - 1), F.col("ahead")
    elif start.startswith("^") and "|" not in start:
        return units.withColumns({"start": F.regexp_like("value", _regex(rules, rules.start)), "_whole": F.lit(True)})
    pieces = _pieces(F.col("value"), _start_pattern(rules), ahead)
    cut = units.select(*others, "width", F.octet_length("value").alias("_bytes"), pieces.alias("_p"))
    cut = cut.select(*others, "width", "_bytes", F.size("_p").alias("_n"), F.posexplode("_p").alias("_at", "value"))
    last = F.col("_at") == F.col("_n") - 1
    # The break at the end of the line belongs to its last piece.
    size = F.octet_length("value").cast("bigint")
    return (cut.where((F.col("value") != "") | (F.col("_at") > 0) | (F.col("_n") == 1))
            .select(*others, "value", (F.col("_at") > 0).alias("start"), last.alias("_whole"), F.when(
                last, size + F.col("width") - F.col("_bytes")).otherwise(size).alias("width")))


def mark_lines(units: DataFrame, rules: RuleSet) -> DataFrame:
    """``start`` and ``close`` per line or piece of one; it may open a record and close it."""
    units = split_lines(units, rules)
    line = F.concat("value", F.when(F.col("_whole"), F.lit("\n")).otherwise(F.lit("")))
    close = F.coalesce(F.regexp_like(line, _regex(rules, rules.end)), F.lit(False)) if rules.end else F.lit(False)
    return units.withColumn("close", close).drop("_whole")


def rule_segments(units: DataFrame, rules: RuleSet) -> DataFrame:
    units = mark_lines(units, rules)
    return cut_records(glue_records(units, index_blocks(units, False, False), False, False), rules)


def cut_records(glued: DataFrame, rules: RuleSet) -> DataFrame:
    """Whole lines from a start match on, down to the text in front of the end match."""
    text = F.concat("raw", F.lit("\n"))
    at = F.regexp_instr(text, _regex(rules, rules.end)) if rules.end else F.lit(0)
    df = glued.withColumns({"_text": text, "_end": at})
    cut = F.substr("_text", F.lit(1), F.col("_end") - 1)
    return df.select(
        "source", "idx", "offset",
        F.when(F.col("_end") > 0, F.octet_length(cut).cast("bigint")).otherwise(F.col("length")).alias("length"),
        F.make_valid_utf8(F.when(F.col("_end") > 0, cut).otherwise(strip_cr(F.col("raw")))).alias("raw"))


_FIRST_STEPS = 16


def scan_fields(raw: Column, rules: RuleSet) -> Column:
    """The slots after a scan through all of ``raw``, see ``FieldRule``.

    Every step reads a character at least, so as many steps as characters are enough. Most records
    take a few; the others go on.
    """
    patterns = [_DIALECT + rules.expand(f.pattern) for f in rules.fields]

    def candidate(s, i):
        rule, pattern = rules.fields[i], patterns[i]
        at = F.regexp_instr(s["rest"], F.lit(pattern))
        if rule.states:
            at = F.when(s["state"].isin(*rule.states), at).otherwise(F.lit(0))
        return _let(at, lambda at: F.when(at > 0, _let(
            F.length(F.regexp_extract(s["rest"], pattern, 0)),
            lambda n: F.when(n > 0, F.struct(at.alias("at"), (-n).alias("n"), F.lit(i).alias("rule"))))))

    def move(s, best):
        text = F.substr(s["rest"], best["at"])
        state, slots = s["state"], {name: s[name] for name in SLOTS}
        for i, rule in enumerate(rules.fields):
            chosen = best["rule"] == i
            if rule.state_to:
                state = F.when(chosen, F.lit(rule.state_to)).otherwise(state)
            slots[rule.slot] = F.when(chosen, F.regexp_extract(s["rest"], patterns[i], rule.group)).otherwise(slots[rule.slot])
        return F.struct(F.substr(text, 1 - best["n"]).alias("rest"), state.alias("state"), F.lit(True).alias("live"),
                        *[slots[name].alias(name) for name in SLOTS])

    def stop(s):
        return F.struct(s["rest"].alias("rest"), s["state"].alias("state"), F.lit(False).alias("live"),
                        *[s[name].alias(name) for name in SLOTS])

    def step(s, _):
        best = F.array_min(F.array(*[candidate(s, i) for i in range(len(rules.fields))]))
        return F.when(s["live"], _let(best, lambda b: F.when(b.isNotNull(), move(s, b)).otherwise(stop(s)))).otherwise(s)

    nothing = F.lit(None).cast("string")
    start = F.struct(F.coalesce(raw, F.lit("")).alias("rest"), F.lit("INITIAL").alias("state"), F.lit(True).alias("live"),
                     *[nothing.alias(name) for name in SLOTS])
    begun = F.aggregate(F.sequence(F.lit(1), F.lit(_FIRST_STEPS)), start, step)
    done = _let(begun, lambda s: F.when(s["live"], F.aggregate(
        F.sequence(F.lit(0), F.length(s["rest"])), s, step)).otherwise(s))
    return _let(done, lambda s: F.struct(*[F.when(s[name] != "", s[name]).alias(name) for name in SLOTS]))


def _apply(rules: RuleSet, rule: FieldRule):
    """One rule as a step from the reading so far to the next one."""
    pattern = _DIALECT + rules.expand(rule.pattern)

    def step(s):
        at = F.regexp_instr(s["rest"], F.lit(pattern))

        def take(p):
            def if_hit(value, name):
                return F.when(p["at"] > 0, value).otherwise(s[name])

            whole = F.regexp_extract(s["rest"], pattern, 0)
            slots = {rule.slot: if_hit(F.regexp_extract(s["rest"], pattern, rule.group), rule.slot)}
            return F.struct(
                if_hit(F.substr(s["rest"], p["at"] + F.length(whole)), "rest").alias("rest"),
                *[slots.get(name, s[name]).alias(name) for name in SLOTS])

        return _let(F.struct(at.alias("at")), take)

    return step


def _is_chain(fields: tuple[FieldRule, ...]) -> bool | None:
    """True when each rule waits for the one before and none can act again, False when no rule has
    states, None otherwise."""
    if _stateless(fields):
        return False
    state = "INITIAL"
    seen = {state}
    for f in fields:
        if f.states != (state,):
            return None
        if f is fields[-1] and f.state_to is None:
            # It stays in its state, so it must read all that is left.
            return True if f.pattern.startswith("(?s)") and f.pattern.endswith(".*") else None
        state = f.state_to or state
        if state in seen:
            return None
        seen.add(state)
    return True


def _stateless(fields: tuple[FieldRule, ...]) -> bool:
    return all(not f.states and f.state_to is None for f in fields)


# Parts of a pattern that look at the text before it, or at other groups by number.
_LOOKS_BACK = re.compile(r"(?<!\[)\^|\(\?<|\\[ABGZbzk1-9]")


def single_pattern(rules: RuleSet) -> tuple[str, dict[str, int]] | None:
    """One pattern with a group per slot that reads like the rules one after the other.

    Each step skips to the first match and never comes back (atomic groups). None when states
    branch, a slot is filled twice, or a pattern depends on more than the text ahead of it.
    """
    chain = _is_chain(rules.fields)
    slots = [f.slot for f in rules.fields]
    if chain is None or not slots or len(set(slots)) < len(slots):
        return None
    steps, groups, n = [], {}, 0
    for i, rule in enumerate(rules.fields):
        pattern = rules.expand(rule.pattern)
        if i and _LOOKS_BACK.search(pattern):
            return None
        try:
            inner = re.compile(pattern).groups
        except re.error:
            return None
        groups[rule.slot] = n + 1 + rule.group
        n += 1 + inner
        steps.append(f"(?>[\\s\\S]*?({pattern}))")
    if not chain:
        return _DIALECT + "^" + "".join(f"{s}?+" for s in steps), groups
    nested = ""
    for step in reversed(steps):
        nested = f"(?:{step}{nested})?+"
    return _DIALECT + "^" + nested, groups


def extract_fields(raw: Column, rules: RuleSet) -> Column:
    """Struct of the slot texts. Rules in a row become one pattern, others are scanned."""
    single = single_pattern(rules)
    if single:
        pattern, groups = single

        def slot(name):
            if name not in groups:
                return F.lit(None).cast("string")
            return F.nullif(F.regexp_extract(raw, pattern, groups[name]), F.lit(""))

        return F.struct(*[slot(name).alias(name) for name in SLOTS])
    if not _stateless(rules.fields):
        return scan_fields(raw, rules)
    current = F.struct(raw.alias("rest"), *[F.lit(None).cast("string").alias(s) for s in SLOTS])
    for rule in rules.fields:
        current = _let(current, _apply(rules, rule))
    return _let(current, lambda c: F.struct(*[F.when(c[s] != "", c[s]).alias(s) for s in SLOTS]))


def parse_rules(segments: DataFrame, rules: RuleSet, on_malformed: str = "drop") -> DataFrame:
    slots = F.col("slots")
    patterns = (rules.timestamp_format,) if rules.timestamp_format else ()
    slots_of = extract_fields(F.col("raw"), rules)
    # One pattern per slot is cheap, and a slot nobody asks for is then not computed.
    df = (segments.withColumn("slots", slots_of) if single_pattern(rules)
          else with_once(segments, "slots", slots_of))
    return apply_malformed_policy(to_records(df.withColumns({
        "timestamp": parse_timestamp(slots["timestamp"], *patterns),
        "level": parse_level(slots["level"]),
        **{s: slots[s] for s in ("logger", "thread", "message", "exception")},
        "malformed": F.lit(None).cast("string"),
    })), on_malformed)


def read_rules(spark: SparkSession, path, rules: RuleSet, encoding: str = "UTF-8",
               on_malformed: str = "drop", head: int | None = None) -> DataFrame:
    units = scan_units(spark, path, encoding=encoding, head=head)
    return parse_rules(rule_segments(units, rules), rules, on_malformed)
