"""Display and search helpers on text columns."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType

ZERO_WIDTH_BREAK = " \u200b"


def short_logger(logger: Column) -> Column:
    """Part after the last dot; null for a null or empty logger."""
    return F.when(logger != "", F.substring_index(logger, ".", -1))


def flatten_message(message: Column) -> Column:
    """Put a message on one line; ``restore_message`` brings the breaks back."""
    return F.replace(message, F.lit("\r\n"), F.lit(ZERO_WIDTH_BREAK))


def restore_message(flat: Column) -> Column:
    return F.replace(flat, F.lit(ZERO_WIDTH_BREAK), F.lit("\r\n"))


def format_timestamp(timestamp: Column, style: str = "long") -> Column:
    """``short`` is the time of day, ``long`` has the date as well."""
    patterns = {"short": "HH:mm:ss", "long": "yyyy-MM-dd HH:mm:ss"}
    if style not in patterns:
        raise ValueError(f"style must be one of {sorted(patterns)}")
    return F.date_format(timestamp, patterns[style])


def base_name(path: Column) -> Column:
    """File name after the last slash or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)\z", 1)


def format_count(n: Column) -> Column:
    """Grouped digits, empty for zero."""
    return F.when(n == 0, F.lit("")).otherwise(F.format_number(n, 0))


def format_records(n: Column) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(" records"))


def format_percent(percent: Column) -> Column:
    """Whole percent with its sign, from a number between 0 and 100."""
    return F.concat(F.format_number(percent, 0), F.lit("%"))


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def occurrence_count(text: Column, literal: str) -> Column:
    """Number of non-overlapping matches, without listing them."""
    if not literal:
        raise ValueError("the literal must not be empty")
    size = len(literal.encode())
    rest = F.octet_length(F.replace(text, F.lit(literal), F.lit("")))
    return ((F.octet_length(text) - rest) / F.lit(size)).cast("bigint")


def occurrences(text: Column, literal: str, limit: int | None = None) -> Column:
    """Byte offsets of every match, overlapping ones too, as ``ARRAY<INT>``.

    Built-in expressions can only list positions by testing each byte or by growing an array
    step by step, both quadratic on long text; an Arrow batch with a byte search is linear.
    """
    if not literal:
        raise ValueError("the literal must not be empty")
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    needle = literal.encode()

    def find_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for hay in batch.cast(pa.binary()).to_pylist():
                if hay is None:
                    out.append(None)
                    continue
                found, at = [], hay.find(needle)
                while at >= 0 and (limit is None or len(found) < limit):
                    found.append(at)
                    at = hay.find(needle, at + 1)
                out.append(found)
            yield pa.array(out, pa.list_(pa.int32()))

    # A row without the literal never reaches Python.
    udf = F.arrow_udf(find_all, ArrayType(IntegerType()))
    hits = udf(F.when(F.contains(text, F.lit(literal)), text))
    return F.when(text.isNotNull(), F.coalesce(hits, F.array().cast("array<int>")))
