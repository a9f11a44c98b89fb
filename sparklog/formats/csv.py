"""Delimited text with a header line and quoted fields that may span lines."""

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import scratch
from ..functions.levels import parse_level
from ..functions.times import parse_timestamp
from ..operators.blocks import glue_records, index_blocks
from ..sources.files import scan_units
from .common import apply_malformed_policy, count_quotes, join_small, strip_cr, to_records, with_once

# Header names with a meaning and the record column each one fills.
ROLES = {"time": "timestamp", "logger": "logger", "level": "level",
         "message": "message", "exception": "exception"}
# Delimiters tried on a header; the first one wins a tie.
DELIMITERS = (";", ",")


@dataclass(frozen=True)
class CsvLayout:
    """Explicit layout of files without a header line; positions start at 0."""

    field_count: int
    delimiter: str = ";"
    timestamp: int | None = None
    logger: int | None = None
    level: int | None = None
    message: int | None = None
    exception: int | None = None
    attributes: dict[str, int] = field(default_factory=dict)


def guess_delimiter(header: Column) -> Column:
    first, second = DELIMITERS
    return F.when(F.size(F.split(header, re.escape(second))) > F.size(F.split(header, re.escape(first))),
                  F.lit(second)).otherwise(F.lit(first))


def split_fields(record: Column, delimiter: str, quote: str = '"') -> Column:
    """Fields of one record; delimiters inside of quotes do not count, one outer quote on each
    side goes away, doubled quotes stay, and an unterminated last field is left out."""
    d, q = re.escape(delimiter), re.escape(quote)
    one_field = f"{d}((?:[^{q}{d}]++|{q}[^{q}]*+(?:{q}|\\z))*+)"
    quotes = count_quotes(record, quote)
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), record), F.lit(one_field), F.lit(1))
    closed = F.when(quotes % 2 == 1,
                    F.slice(found, F.lit(1), F.size(found) - 1)).otherwise(found)
    trimmed = F.transform(closed, lambda x: F.when(
        F.startswith(x, F.lit(quote)) | F.endswith(x, F.lit(quote)),
        F.regexp_replace(x, f"^{q}|{q}\\z", "")).otherwise(x))
    return F.when(quotes == 0, F.split(record, d, -1)).otherwise(trimmed)


def header_layout(headers: DataFrame, delimiter: str | None = None, quote: str = '"') -> DataFrame:
    """Column roles read from header texts: ``delimiter``, ``n_fields``, one position per role
    and the remaining columns as ``attributes``. A repeated name keeps its last position."""
    text = strip_cr(F.col("header"))
    df = headers.withColumn("delimiter", F.lit(delimiter) if delimiter else guess_delimiter(text))
    options = (delimiter,) if delimiter else DELIMITERS
    df = df.withColumn("names", F.coalesce(*[
        F.when(F.col("delimiter") == d, split_fields(text, d, quote)) for d in options]))
    names = F.col("names")
    lowered = F.transform(names, lambda x: F.lower(x))

    def last_position(values, name):
        back = F.array_position(F.reverse(values), name)
        return F.when(back > 0, (F.size(values) - back).cast("int"))

    numbered = F.transform(names, lambda x, i: F.struct(x.alias("name"), i.alias("position")))
    extra = F.filter(numbered, lambda c: ~F.lower(c["name"]).isin(*ROLES)
                     & (c["position"] == last_position(names, c["name"])))
    return df.select(
        *headers.columns, "delimiter", F.size(names).alias("n_fields"),
        *[last_position(lowered, F.lit(role)).alias(f"{target}_at")
          for role, target in ROLES.items()],
        extra.alias("attributes"))


def quote_parity(units: DataFrame, quote: str = '"') -> DataFrame:
    """``start`` says that a line holds an odd number of quotes."""
    return units.withColumn("start", count_quotes(F.col("value"), quote) % 2 == 1)


def csv_segments(units: DataFrame, header: bool = True, quote: str = '"') -> tuple[DataFrame, DataFrame | None]:
    """Segments with a ``layout`` number, and the table of distinct header texts by number."""
    units = quote_parity(units, quote)
    blocks = index_blocks(units, quoted=True, header=header)
    headers = None
    if header:
        blocks, headers = number_headers(blocks)
    return glued_csv(units, blocks, header), headers


def number_headers(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks with the ``layout`` number of their file's header, and the numbered headers.
    All files of one logger share a header, so this table is far smaller than the blocks."""
    headers = scratch.write_table(
        blocks.where("file_header is not null").select(F.col("file_header").alias("header"))
        .distinct().select("header", F.monotonically_increasing_id().alias("layout")), "headers")
    numbered = blocks.join(headers.withColumnRenamed("header", "file_header"),
                           "file_header", "left")
    return numbered, headers


def glued_csv(units: DataFrame, blocks: DataFrame, header: bool) -> DataFrame:
    segments = glue_records(units, blocks, quoted=True, header=header)
    return segments.withColumn("raw", F.make_valid_utf8(strip_cr(F.col("raw"))))


def _field(fields: Column, position: Column | int | None) -> Column:
    if position is None:
        return F.lit("")
    return F.coalesce(F.get(fields, position), F.lit(""))


def parse_csv(segments: DataFrame, layout: CsvLayout | DataFrame | None, quote: str = '"',
              time_patterns: tuple = (), on_malformed: str = "drop",
              delimiter: str | None = None) -> DataFrame:
    """Fields to record columns. ``layout`` is explicit or the table made by
    ``header_layout`` (for the same ``delimiter``) with a ``layout`` number to join on; without one
    the segments have that table's columns themselves."""
    fields = F.col("fields")
    if isinstance(layout, CsvLayout):
        df = with_once(segments, "fields", split_fields(F.col("raw"), layout.delimiter, quote))
        at = {target: getattr(layout, target) for target in ROLES.values()}
        n_fields = F.lit(layout.field_count)
        pairs = [x for name, i in layout.attributes.items() for x in (F.lit(name), _field(fields, i))]
        attributes = F.create_map(*pairs) if pairs else F.lit(None)
    else:
        df = segments if layout is None else join_small(segments, layout, "layout", "inner")
        df = with_once(df, "fields", F.coalesce(*[
            F.when(F.col("delimiter") == d, split_fields(F.col("raw"), d, quote))
            for d in ((delimiter,) if delimiter else DELIMITERS)]))
        at = {target: F.col(f"{target}_at") for target in ROLES.values()}
        n_fields = F.col("n_fields")
        attributes = F.when(F.size("attributes") > 0, F.map_from_arrays(
            F.transform("attributes", lambda a: a["name"]),
            F.transform("attributes", lambda a: _field(fields, a["position"]))))
    return apply_malformed_policy(to_records(df.withColumns({
        "timestamp": parse_timestamp(_field(fields, at["timestamp"]), *time_patterns),
        "level": parse_level(_field(fields, at["level"])),
        "logger": _field(fields, at["logger"]),
        "message": _field(fields, at["message"]),
        "exception": _field(fields, at["exception"]),
        "attributes": attributes,
        "malformed": F.when(F.size(fields) != n_fields, F.lit("field count")),
    })), on_malformed)


def read_csv(spark: SparkSession, path, layout: CsvLayout | None = None,
             delimiter: str | None = None, quote: str = '"', encoding: str = "UTF-8",
             time_patterns: tuple = (), on_malformed: str = "drop",
             head: int | None = None) -> DataFrame:
    """``layout`` reads files without a header line; otherwise each file's header decides."""
    units = scan_units(spark, path, encoding=encoding, head=head)
    segments, headers = csv_segments(units, layout is None, quote)
    if layout is None:
        layout = header_layout(headers, delimiter, quote)
    return parse_csv(segments, layout, quote, time_patterns, on_malformed, delimiter)
