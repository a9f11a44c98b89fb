"""Which format a file has, decided on its first characters."""

from pyspark.sql import DataFrame, functions as F

from ..formats.registry import sniffable


def detect_candidates(heads: DataFrame) -> DataFrame:
    """All formats that accept the ``head`` text, in order of registration."""
    known = F.array(*[F.when(f.sniff(F.col("head")), F.lit(f.name)) for f in sniffable()])
    return heads.select("source", F.filter(known, lambda x: x.isNotNull()).alias("candidates"))


def detect_format(heads: DataFrame, override: str | None = None) -> DataFrame:
    """The first candidate, plain text without one, or ``override`` where it applies."""
    best = F.coalesce(F.get("candidates", 0), F.lit("plain"))
    return detect_candidates(heads).select(
        "source", "candidates", (F.lit(override) if override else best).alias("format"))
