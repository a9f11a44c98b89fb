"""Level names and their order."""

from functools import reduce

from pyspark.sql import Column, functions as F

from ..model import LEVELS


def parse_level(text: Column) -> Column:
    """Canonical level name, matched without regard to case and without trimming; else null.

    A map literal, because a chain of conditions would compute ``text`` once per level.
    """
    names = F.create_map(*[F.lit(x) for name in LEVELS for x in (name.lower(), name)])
    return F.try_element_at(names, F.lower(text))


def level_ordinal(level: Column) -> Column:
    """0 for Trace up to 5 for Fatal, null for no level."""
    return reduce(lambda acc, i: acc.when(level == LEVELS[i], F.lit(i)), range(1, len(LEVELS)),
                  F.when(level == LEVELS[0], F.lit(0))).cast("tinyint")


def at_least(level: Column, floor: str) -> Column:
    """Levels as severe as ``floor`` or more; written as a set so that Parquet can skip on it."""
    return level.isin(*LEVELS[LEVELS.index(floor):])
