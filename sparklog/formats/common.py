"""Pieces shared by the formats."""

from pyspark.sql import Column, DataFrame, functions as F

from ..model import RECORD_SCHEMA
from .. import scratch


def strip_cr(text: Column) -> Column:
    """Drop one carriage return at the end: the other half of a line break."""
    return F.when(F.endswith(text, F.lit("\r")), F.left(text, F.length(text) - 1)).otherwise(text)


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed once per row. A plain projection would be copied
    into every filter and expression that uses it; the output of a generator is not."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def count_quotes(text: Column, quote: str) -> Column:
    removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(quote), F.lit("")))
    size = len(quote.encode())
    return removed if size == 1 else (removed / size).cast("int")


def empty_field(name: str) -> Column:
    return F.lit(None).cast(RECORD_SCHEMA[name].dataType).alias(name)


def to_records(df: DataFrame) -> DataFrame:
    """The fixed record schema; columns the format does not know become null."""
    return df.select(*[c for c in df.columns if c == "origin"], *[
        (F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
         else empty_field(f.name)) for f in RECORD_SCHEMA.fields])


_SALTS = 64


def join_small(records: DataFrame, small: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join a table with one row per ``key`` (source, layout) onto records.

    The small side is counted and broadcast within the bound. Beyond it the join is salted by
    record number, because one key may own a large share of all records.
    """
    if small.count() <= scratch.MAX_BROADCAST_ROWS:
        return records.join(F.broadcast(small), key, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return (records.withColumn("_salt", F.pmod("idx", F.lit(_SALTS)).cast("int"))
            .join(salted, [key, "_salt"], how).drop("_salt"))


def apply_malformed_policy(records: DataFrame, policy: str) -> DataFrame:
    """``drop`` bad records, ``keep`` them with their reason, or ``stop`` a file at its first one.

    Record numbers are given before, so a dropped record leaves a gap.
    """
    if policy == "keep":
        return records
    if policy == "drop":
        return records.where("malformed is null")
    if policy != "stop":
        raise ValueError("on_malformed must be 'drop', 'keep' or 'stop'")
    first_bad = scratch.write_table(
        records.where("malformed is not null").groupBy("source")
        .agg(F.min("idx").alias("_first_bad")), "first-bad")
    return (join_small(records, first_bad, "source")
            .where("_first_bad is null or idx < _first_bad").drop("_first_bad"))
