"""Level statistics."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..model import LEVELS
from .numbering import BUCKET, bucket_of, dense_number, join_cells

# Fixed value: records per statistics batch.
BATCH_RECORDS = 8192


def level_counts(df: DataFrame, *by: str) -> DataFrame:
    """Records per level; records without a level do not count."""
    return (df.where(F.col("level").isNotNull()).groupBy(*by, "level")
            .agg(F.count("*").alias("count")))


def level_counts_wide(df: DataFrame, *by: str) -> DataFrame:
    """One column per level, zero where there is none."""
    return df.groupBy(*by).agg(*[
        F.count_if(F.col("level") == name).alias(f"{name.lower()}_count") for name in LEVELS])


def level_index(df: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Record numbers per level as rows ``source, level, pos, idx``.

    Rows and not one array per level: a level may hold a large share of all records.
    """
    leveled = df.where(F.col("level").isNotNull()).select("source", "level", "idx")
    return dense_number(leveled, ["source", "level"], "pos", bucket=bucket).select(
        "source", "level", "pos", "idx")


def record_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("count"))


def _batch(size: int) -> Column:
    return bucket_of("idx", size).alias("batch")


def batch_level_counts(df: DataFrame, size: int = BATCH_RECORDS) -> DataFrame:
    """Records per level in batches of record numbers."""
    return (df.where(F.col("level").isNotNull())
            .groupBy("source", _batch(size), "level").agg(F.count("*").alias("count")))


def batch_status(df: DataFrame, size: int = BATCH_RECORDS) -> DataFrame:
    """Status of the last record of each batch, and the batch's highest progress.

    Expects a ``status`` struct per record.
    """
    return df.groupBy("source", _batch(size)).agg(
        F.max_by("status", "idx").alias("status"), F.max("status.progress").alias("progress"))


def status_sampled(df: DataFrame, time: str = "timestamp", value: str = "idx",
                   every: str = "2 seconds") -> DataFrame:
    """Latest value in each time window that has one."""
    return (df.groupBy(F.window(time, every)).agg(
        F.max_by(value, F.struct(time, value)).alias(value))
        .select(F.col("window.start").alias("start"), value))


def status_sampled_stream(df: DataFrame, time: str = "timestamp", value: str = "idx",
                          every: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """The same for a stream: a window is given out once nothing older than ``late`` is waited for, and its
    state goes. Windows without a value never show."""
    return status_sampled(df.withWatermark(time, late), time, value, every)


def debounced(df: DataFrame, *by: str, time: str = "timestamp", order: str = "idx",
              quiet: str = "700 milliseconds", bucket: int = BUCKET) -> DataFrame:
    """Last record of each burst, in arrival order: a burst ends when the next record comes
    more than the quiet period later.

    Bursts are numbered in buckets of the order column, and what crosses a bucket comes from
    one row per bucket, so a burst or a source may be of any size.
    """
    cell = [*by, "_bucket"]
    placed = df.withColumn("_bucket", bucket_of(order, bucket))
    buckets = W.partitionBy(*by).orderBy("_bucket")
    earlier = buckets.rowsBetween(W.unboundedPreceding, -1)
    last_before = (placed.groupBy(*cell).agg(F.max_by(time, order).alias("_last"))
                   .select(*cell, F.lag("_last").over(buckets).alias("_before")))
    inside = W.partitionBy(*cell).orderBy(order)
    marked = join_cells(placed, last_before, cell).withColumn(
        "_previous", F.coalesce(F.lag(time).over(inside), F.col("_before")))
    starts = F.col("_previous").isNull() | (
        F.col(time) > F.col("_previous") + F.expr(f"interval '{quiet}'"))
    marked = marked.withColumn("_starts", starts.cast("bigint"))
    before = (marked.groupBy(*cell).agg(F.sum("_starts").alias("_n"))
              .select(*cell, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")))
    numbered = join_cells(marked.withColumn("_burst", F.sum("_starts").over(
        inside.rowsBetween(W.unboundedPreceding, 0))), before, cell)
    return (numbered.withColumn("_burst", F.col("_base") + F.col("_burst"))
            .groupBy(*by, "_burst").agg(
                F.min_by(time, order).alias("first_at"), F.max_by(time, order).alias("last_at"),
                F.max(order).alias(order))
            .drop("_burst"))


def debounced_stream(df: DataFrame, *by: str, time: str = "timestamp", order: str = "idx",
                     quiet: str = "700 milliseconds") -> DataFrame:
    """The same for a stream with a watermark, by Spark's session windows."""
    return (df.groupBy(*by, F.session_window(time, quiet)).agg(
        F.min(time).alias("first_at"), F.max(time).alias("last_at"),
        F.max_by(order, F.struct(time, order)).alias(order))
        .select(*by, "first_at", "last_at", order))
