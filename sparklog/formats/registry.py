"""Named formats: how to recognise one, how to read files and how to read payloads."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .csv import DELIMITERS, CsvLayout, parse_csv, read_csv
from .log4j import EVENT_END, EVENT_START, _events, parse_log4j, read_log4j
from .plain import parse_plain, read_plain
from .common import strip_cr
from .rules import RuleSet, parse_rules, read_rules, rule_texts


@dataclass(frozen=True)
class LogFormat:
    """``sniff`` tests the first characters of a file and is null for formats that are only
    used when asked for. ``payload`` splits one message into record texts, given the arguments
    of ``parse`` if ``payload_args``; ``parse`` turns rows with ``raw`` into records. Files are scanned in
    pieces between two of ``separator``."""

    name: str
    read: Callable[..., DataFrame]
    parse: Callable[..., DataFrame]
    payload: Callable[..., Column]
    sniff: Callable[[Column], Column] | None = None
    payload_args: bool = False
    separator: str = "\n"


def _not_blank(head: Column) -> Column:
    return F.trim(F.regexp_replace(head, r"\s+", " ")) != ""


def sniff_csv(head: Column) -> Column:
    """The first non-empty line has a column named level or message."""
    first = strip_cr(F.element_at(F.filter(F.split(head, "\n"), lambda x: x != ""), 1))
    names = F.split(F.lower(first), r"[;,|]")
    return _not_blank(head) & F.coalesce(
        F.arrays_overlap(names, F.array(F.lit("level"), F.lit("message"))), F.lit(False))


def sniff_log4j(head: Column) -> Column:
    return F.contains(head, F.lit(EVENT_START.rstrip()))


def _quoted_lines(text: Column) -> Column:
    """Lines of a message; a line break between quotes does not end one."""
    lines = F.regexp_extract_all(text, F.lit(r'(?:[^"\n]++|"[^"]*+(?:"|\z))++'), F.lit(0))
    return F.filter(F.transform(lines, strip_cr), lambda x: x != "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\r?\n"), lambda x: x != "")


def _closed_events(text: Column) -> Column:
    return F.transform(F.flatten(F.transform(F.split(text, EVENT_END), _events)),
                       lambda x: F.concat(x, F.lit(EVENT_END)))


_FORMATS: dict[str, LogFormat] = {}


def register_format(fmt: LogFormat) -> None:
    """Add or replace a format. Detection tries formats in the order of registration."""
    _FORMATS[fmt.name] = fmt


def get_format(name: str) -> LogFormat:
    if name not in _FORMATS:
        raise ValueError(f"unknown format {name!r}; known: {sorted(_FORMATS)}")
    return _FORMATS[name]


def sniffable() -> list[LogFormat]:
    return [f for f in _FORMATS.values() if f.sniff is not None]


register_format(LogFormat("csv", read_csv, parse_csv, _quoted_lines, sniff_csv))
register_format(LogFormat("log4j", read_log4j, parse_log4j, _closed_events, sniff_log4j,
                          separator=EVENT_END))
register_format(LogFormat("plain", read_plain, parse_plain, _lines))
register_format(LogFormat("rules", read_rules, parse_rules, lambda text, rules, *_, **__: rule_texts(text, rules),
                          payload_args=True))

__all__ = ["DELIMITERS", "CsvLayout", "LogFormat", "RuleSet", "get_format", "register_format",
           "sniff_csv", "sniff_log4j", "sniffable"]
