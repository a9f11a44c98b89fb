"""Plain text: every non-empty line is a record."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.blocks import clamp_length, number_blocks, number_units
from ..sources.files import scan_units
from .common import strip_cr, to_records


def weigh_lines(units: DataFrame) -> DataFrame:
    """Lines without their carriage return; an empty one weighs nothing."""
    line = strip_cr(F.col("value"))
    return units.withColumns({"value": line, "weight": (F.length(line) > 0).cast("int")})


def plain_segments(units: DataFrame, index: bool = True) -> DataFrame:
    units = weigh_lines(units)
    if not index:
        return (units.where("weight = 1")
                .select("source", F.make_valid_utf8("value").alias("raw")))
    segments = placed_lines(units, number_blocks(units))
    return segments.withColumn("length", clamp_length(F.col("length"), F.col("size"))).drop("size")


def placed_lines(units: DataFrame, blocks: DataFrame) -> DataFrame:
    return (number_units(units, blocks).where("weight = 1")
            .select("source", "idx", "offset", F.col("width").alias("length"),
                    F.make_valid_utf8("value").alias("raw"), "size"))


def parse_plain(segments: DataFrame) -> DataFrame:
    return to_records(segments.withColumn("message", F.col("raw")))


def read_plain(spark: SparkSession, path, encoding: str = "UTF-8", index: bool = True,
               head: int | None = None) -> DataFrame:
    """``index=False`` leaves record numbers and offsets out and stays a plain scan."""
    return parse_plain(plain_segments(scan_units(spark, path, encoding=encoding, head=head),
                                      index))
