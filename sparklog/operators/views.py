"""Views on records: single records, pages, batches, and filtered views with own numbers."""

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..formats.common import strip_cr
from ..formats.registry import get_format
from ..sources.files import UNREAD, scan_units
from ..sources.reader import read_logs
from .numbering import BUCKET, dense_number


def read_record(df: DataFrame, idx: int, source: str | None = None) -> DataFrame:
    """The record with this number, empty when there is none. On written records both
    conditions are pushed into the scan."""
    hit = df.where(F.col("idx") == idx)
    return hit if source is None else hit.where(F.col("source") == source)


def page_records(df: DataFrame, first: int, count: int, source: str | None = None) -> DataFrame:
    """Records ``first`` up to ``first + count - 1``; out of range is an empty page."""
    page = df.where(F.col("idx").between(first, first + count - 1))
    return page if source is None else page.where(F.col("source") == source)


def record_detail(df: DataFrame, idx: int, source: str | None = None) -> DataFrame:
    return read_record(df, idx, source).select("idx", "message", "exception")


def batch_lookup(df: DataFrame, requests: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per request; a request without a record keeps empty record columns.

    The records are first reduced to the requested ones, so that the record side of the outer
    join is as small as the requests. Catalyst broadcasts the requests if they are small.
    """
    keys = keys or [c for c in ("source", "idx") if c in requests.columns]
    hits = df.join(requests.select(*keys).distinct(), keys, "left_semi")
    return requests.join(hits, keys, "left")


def filtered_view(df: DataFrame, predicate: Column | None = None,
                  bucket: int = BUCKET) -> DataFrame:
    """Matching records with ``local_idx``, dense from 0 in file order per source; ``idx``
    stays the number in the file."""
    hits = df if predicate is None else df.where(predicate)
    return dense_number(hits, ["source"], "local_idx", bucket=bucket)


def filtered_lookup(view: DataFrame, requests: DataFrame) -> DataFrame:
    """Records of a filtered view by ``local_idx``; an unknown number gives an empty record."""
    keys = [c for c in ("source", "local_idx") if c in requests.columns]
    return batch_lookup(view, requests, keys)


def local_index_of(view: DataFrame, requests: DataFrame) -> DataFrame:
    """Local number per requested record number, -1 for records the view does not show."""
    keys = [c for c in ("source", "idx") if c in requests.columns]
    wanted = requests.select(*keys)
    found = view.join(wanted.distinct(), keys, "left_semi").select(*keys, "local_idx")
    return wanted.join(found, keys, "left").withColumn(
        "local_idx", F.coalesce("local_idx", F.lit(-1)))


def zip_starts_ends(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Pair the k-th start with the k-th end of a source, up to the shorter list.

    Both tables have ``source, ordinal, at``; the pair spans ``at`` of both.
    """
    left = starts.select("source", "ordinal", F.col("at").alias("start_at"))
    right = ends.select("source", "ordinal", F.col("at").alias("end_at"))
    return left.join(right, ["source", "ordinal"])


def zip_lists(df: DataFrame, starts: Column, ends: Column) -> DataFrame:
    """The same where each row has the lists of both, in ``source``: nothing is shuffled."""
    lists = df.select("source", starts.alias("starts"), ends.alias("ends"))
    n = F.least(F.size("starts"), F.size("ends"))
    pairs = F.arrays_zip(F.slice("starts", F.lit(1), n).alias("start_at"), F.slice("ends", F.lit(1), n).alias("end_at"))
    return (lists.where(n > 0).select("source", F.posexplode(pairs).alias("ordinal", "pair"))
            .select("source", "ordinal", "pair.*"))


def preview_lines(spark: SparkSession, path, n: int = 20) -> DataFrame:
    """First lines of each file as ``source, line_no, line``; no file is read further."""
    lines = scan_units(spark, path, head=n)
    return lines.select("source", F.col("piece").alias("line_no"),
                        strip_cr(F.col("value")).alias("line"))


def preview_records(records: DataFrame, n: int = 5) -> DataFrame:
    """First records of each source as text, without their empty fields. Read with ``head``,
    the records come from the beginning of each file only."""
    def line(label, value):
        return F.when(value != "", F.concat(F.lit(f"  {label:<11}"), value))

    when = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    report = F.concat_ws(
        "\n",
        F.concat(F.lit("Record #"), F.col("idx") + 1),
        line("Timestamp:", when), line("Level:", F.col("level")),
        line("Logger:", F.col("logger")), line("Message:", F.col("message")),
        line("Exception:", F.col("exception")))
    place = F.row_number().over(W.partitionBy("source").orderBy("idx"))
    return (records.withColumn("_place", place).where(F.col("_place") <= n)
            .select("source", "idx", report.alias("report")))


def preview_files(spark: SparkSession, path, format: str, n: int = 5, lines: int = 64, **kwargs) -> DataFrame:
    """``preview_records`` of the files below ``path``. It reads the first ``lines`` lines of each file, and eight times as many
    as long as a file that goes on shows less than ``n`` records: records may be of any length."""
    while True:
        records = read_logs(spark, path, format, head=lines, **kwargs)
        units = scan_units(spark, path, get_format(format).separator, head=lines)
        short = records.groupBy("source").agg(F.count("*").alias("_n")).where(F.col("_n") >= n)
        going_on = units.where(F.col("size") == UNREAD).select("source").distinct()
        if going_on.join(short, "source", "left_anti").isEmpty():
            return preview_records(records, n)
        lines *= 8
