"""Level and text search."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..model import LEVELS

# Fixed value: a shorter query is refused.
MIN_QUERY = 3
# Fixed value: columns that a text search looks at.
SEARCHED = ("message", "exception", "logger")


def _matches(column: str, query: str, regex: bool, match_case: bool) -> Column:
    text = F.col(column)
    if regex:
        flags = "(?dU)" if match_case else "(?dUiu)"
        hit = text.rlike(flags + query)
    elif match_case:
        hit = F.contains(text, F.lit(query))
    else:
        hit = F.contains(F.lower(text), F.lower(F.lit(query)))
    # An empty or missing text never matches, not even a pattern that accepts nothing.
    return F.coalesce((text != "") & hit, F.lit(False))


def search_condition(query: str | None = None, levels: Iterable[str] | None = None,
                     regex: bool = False, match_case: bool = False) -> Column | None:
    """Condition of a search, or None when the search filters nothing."""
    if query and len(query) < MIN_QUERY:
        raise ValueError(f"a query needs {MIN_QUERY} characters or more")
    chosen = set(LEVELS if levels is None else levels)
    if not chosen:
        raise ValueError("choose one level or more")
    if chosen - set(LEVELS):
        raise ValueError(f"unknown levels {sorted(chosen - set(LEVELS))}; known: {LEVELS}")
    if not query and chosen == set(LEVELS):
        return None
    # While a search is on, records without a level are out.
    condition = F.col("level").isin(*[x for x in LEVELS if x in chosen])
    if query:
        first, *rest = [_matches(c, query, regex, match_case) for c in SEARCHED]
        for other in rest:
            first = first | other
        condition = condition & first
    return condition


def search(df: DataFrame, query: str | None = None, levels: Iterable[str] | None = None,
           regex: bool = False, match_case: bool = False) -> DataFrame:
    condition = search_condition(query, levels, regex, match_case)
    return df if condition is None else df.where(condition)


def filter_records(df: DataFrame, predicate: Column) -> DataFrame:
    """Any condition on record columns; a boolean pandas UDF works as well."""
    return df.where(predicate)
