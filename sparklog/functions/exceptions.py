"""Decoding of exception texts into typed lines and stack frames."""

from pyspark.sql import Column, DataFrame, functions as F

from .text import base_name

# The header and stack frame patterns decide which parts are recognised.
HEADER_PATTERN = r"^((?:\w+[.])+)(\w+): (.*)"
FRAME_PATTERN = (
    r"^\s+\w+\s+((?:\w+[.])+)([\w\[\],<>]+)[.](<.ctor>\w+|[\w\[\],<>]+)[(]([^)]+)?[)]"
    r"(?:\s+\w+\s+(.+):\w+\s+(\d+))?"
)

# Unicode word characters, and only \n ends a line.
_DIALECT = "(?dU)"


def _group(line: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(line, _DIALECT + pattern, group), F.lit(""))


def is_header(line: Column) -> Column:
    return line.rlike(_DIALECT + HEADER_PATTERN)


def is_frame(line: Column) -> Column:
    return line.rlike(_DIALECT + FRAME_PATTERN)


def _header_parts(line: Column) -> Column:
    return F.struct(
        _group(line, HEADER_PATTERN, 1).alias("namespace"),
        _group(line, HEADER_PATTERN, 2).alias("class"),
        F.regexp_extract(line, _DIALECT + HEADER_PATTERN, 3).alias("message"))


def _frame_parts(line: Column) -> Column:
    file = _group(line, FRAME_PATTERN, 5)
    return F.struct(
        _group(line, FRAME_PATTERN, 1).alias("namespace"),
        _group(line, FRAME_PATTERN, 2).alias("class"),
        _group(line, FRAME_PATTERN, 3).alias("method"),
        _group(line, FRAME_PATTERN, 4).alias("params"),
        file.alias("file"),
        base_name(file).alias("file_name"),
        _group(line, FRAME_PATTERN, 6).try_cast("int").alias("line_no"))


def exception_header(line: Column) -> Column:
    """Struct of namespace, class and message; null when the line is no header."""
    return F.when(is_header(line), _header_parts(line))


def stack_frame(line: Column) -> Column:
    """Struct of the frame's parts; null when the line is no frame."""
    return F.when(is_frame(line), _frame_parts(line))


def render_frame(frame: Column) -> Column:
    """Frame struct back to one line, with the base file name when a file is known."""
    head = F.concat(
        F.lit("   at "), frame["namespace"], frame["class"], F.lit("."), frame["method"],
        F.lit("("), F.coalesce(frame["params"], F.lit("")), F.lit(")"))
    place = F.concat(F.lit(" in "), frame["file_name"], F.lit(":line "),
                     frame["line_no"].cast("string"))
    return F.concat(head, F.coalesce(place, F.lit("")))


def exception_lines(df: DataFrame, exception: str = "exception") -> DataFrame:
    """One row per line of each non-empty exception, with its kind and decoded parts."""
    line = F.col("line")
    return (
        df.where(F.col(exception) != "")
        .select("*", F.posexplode(F.split(exception, "\r?\n")).alias("line_no", "line"))
        .withColumn("kind", F.when(is_header(line), "header").when(is_frame(line), "frame")
                    .otherwise("other"))
        .withColumn("header", F.when(F.col("kind") == "header", _header_parts(line)))
        .withColumn("frame", F.when(F.col("kind") == "frame", _frame_parts(line)))
    )
