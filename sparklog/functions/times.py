"""Text and epoch values to TIMESTAMP_NTZ; no result depends on the session time zone."""

import re

from pyspark.sql import Column, functions as F

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"

# Date pattern tokens of the rule files and their Spark spelling.
_TOKENS = {
    "yyyy": "yyyy", "yy": "yy", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M",
    "dddd": "EEEE", "ddd": "EEE", "dd": "dd", "d": "d", "HH": "HH", "H": "H",
    "hh": "hh", "h": "h", "mm": "mm", "m": "m", "ss": "ss", "s": "s", "tt": "a",
    "zzz": "xxx", "K": "XXX",
}


def translate_pattern(pattern: str) -> str:
    """Rewrite a .NET custom date pattern for Spark; letters that are no token get quoted."""
    out = []
    for match in re.finditer(r"'[^']*'|([A-Za-z])\1*|[^A-Za-z']+", pattern):
        text = match.group()
        if not text[0].isalpha():
            out.append(text)
        elif text in _TOKENS:
            out.append(_TOKENS[text])
        elif set(text) <= {"f"} or set(text) <= {"F"}:
            out.append("S" * len(text))
        else:
            out.append(f"'{text}'")
    return "".join(out)


def _from_instant(instant: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr(_EPOCH))


def parse_timestamp(text: Column, *patterns: str) -> Column:
    """First pattern that fits wins; without patterns an ISO date and time is read; else null."""
    if not patterns:
        return text.try_cast("timestamp_ntz")
    readings = []
    for pattern in patterns:
        spark_pattern = translate_pattern(pattern)
        zoned = any(token in spark_pattern for token in ("xxx", "XXX"))
        value = text if zoned else F.concat(text, F.lit(" +0000"))
        layout = spark_pattern if zoned else spark_pattern + " Z"
        readings.append(_from_instant(F.try_to_timestamp(value, F.lit(layout)).cast("timestamp_ltz")))
    return F.coalesce(*readings)


def epoch_millis(text: Column, precision: str = "s") -> Column:
    """Milliseconds since 1970 as UTC wall time, rounded half to even to seconds unless ``ms``."""
    millis = text.try_cast("bigint")
    if precision == "ms":
        return F.timestamp_add("MILLISECOND", millis, F.expr(_EPOCH))
    if precision != "s":
        raise ValueError("precision must be 's' or 'ms'")
    seconds = F.bround(millis / F.lit(1000.0), 0).cast("bigint")
    return F.timestamp_add("SECOND", seconds, F.expr(_EPOCH))
