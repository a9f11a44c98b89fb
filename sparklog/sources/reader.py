"""Entry points: files of one or of mixed formats, and tables of message payloads."""

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..formats.registry import get_format
from ..operators.detect import detect_format
from .files import read_heads


def read_logs(spark: SparkSession, path, format: str = "auto",
              options: dict[str, dict] | None = None, **kwargs) -> DataFrame:
    """Records of all files below ``path``.

    ``format="auto"`` looks at the first characters of each file and sends it to its format.
    ``options`` holds keyword arguments per format name, ``kwargs`` go to a named format.
    """
    options = options or {}
    if format != "auto":
        return get_format(format).read(spark, path, **{**options.get(format, {}), **kwargs})
    if kwargs:
        raise ValueError("with format='auto' give arguments per format in options")
    # One small row per file, like Spark's own file listing on the driver.
    found = detect_format(read_heads(spark, path)).select("format", "source").persist()
    try:
        names = sorted(r["format"] for r in found.select("format").distinct().collect())
        if len(names) <= 1:
            name = names[0] if names else "plain"
            return get_format(name).read(spark, path, **options.get(name, {}))
        paths = {n: [r[0] for r in found.where(F.col("format") == n).select("source")
                     .toLocalIterator()] for n in names}
    finally:
        found.unpersist()
    return reduce(DataFrame.unionByName, [
        get_format(n).read(spark, _plain_paths(paths[n]), **options.get(n, {})) for n in names])


def _plain_paths(sources: list[str]) -> list[str]:
    """File URIs back to paths. A scan takes characters as they are, but for those of patterns."""
    return [re.sub(r"([*?\[\]{}\\])", r"\\\1", unquote(s)) for s in sources]


def from_payloads(payloads: DataFrame, format: str, *args, value: str = "value",
                  encoding: str = "UTF-8", **kwargs) -> DataFrame:
    """Records in a table or stream of binary payloads, for instance from Kafka.

    Empty payloads hold no record. The other columns of the input come along as a struct named
    ``origin``: the place of a payload (topic, partition, offset) is its source's matter.
    """
    fmt = get_format(format)
    text = F.col(value)
    if dict(payloads.dtypes)[value] == "binary":
        text = (F.make_valid_utf8(text.cast("string")) if encoding.upper() == "UTF-8"
                else F.decode(text, encoding))
    kept = [c for c in payloads.columns if c != value]
    rows = payloads.where(F.octet_length(value) > 0).select(
        *([F.struct(*kept).alias("origin")] if kept else []),
        F.explode(fmt.payload(text, *args, **kwargs) if fmt.payload_args else fmt.payload(text))
        .alias("raw"))
    records = fmt.parse(rows, *args, **kwargs)
    return records.drop("source", "idx", "offset", "length")
