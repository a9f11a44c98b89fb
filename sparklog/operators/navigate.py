"""Jumps between records."""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..model import LEVELS
from .numbering import BUCKET, bucket_of, join_cells


def next_record(df: DataFrame, level: str, after: int = -1) -> DataFrame:
    """Number of the next record of a level behind the cursor per source; no row for none.

    Both conditions reach the scan of written records, and the minimum is a partial aggregate.
    """
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}; known: {LEVELS}")
    return (df.where((F.col("level") == level) & (F.col("idx") > after))
            .groupBy("source").agg(F.min("idx").alias("next_idx")))


def next_by_level(df: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """For every record the next record number of each level, null for none.

    Windows run inside of buckets of record numbers. What lies behind a bucket comes from a
    table with one row per bucket. Both look back over falling numbers, since a frame that
    ends at the last row would be computed anew for every row.
    """
    names = {level: f"next_{level.lower()}" for level in LEVELS}
    cell = ["source", "_bucket"]
    marked = df.select(
        "source", "idx", bucket_of("idx", bucket).alias("_bucket"),
        *[F.when(F.col("level") == level, F.col("idx")).alias(f"_{name}")
          for level, name in names.items()])
    behind = W.partitionBy("source").orderBy(F.desc("_bucket")).rowsBetween(
        W.unboundedPreceding, -1)
    later = (marked.groupBy(*cell)
             .agg(*[F.min(f"_{n}").alias(f"_first_{n}") for n in names.values()])
             .select(*cell, *[F.min(f"_first_{n}").over(behind).alias(f"_later_{n}")
                              for n in names.values()]))
    inside = W.partitionBy(*cell).orderBy(F.desc("idx")).rowsBetween(W.unboundedPreceding, -1)
    near = marked.select(*cell, "idx", *[F.min(f"_{n}").over(inside).alias(f"_near_{n}")
                                         for n in names.values()])
    return join_cells(near, later, cell).select(
        "source", "idx", *[F.coalesce(f"_near_{n}", f"_later_{n}").alias(n)
                           for n in names.values()])


def next_of_cursors(df: DataFrame, cursors: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Rows of ``cursors`` (source, after, ...) with the number of the next record of each level behind ``after``, null for none.

    Cursors and leveled records of a bucket pass by once in falling order, each level's last number seen being
    the next one; later buckets come from a table with one row per bucket. Equal cursors are
    looked up once, so a bucket holds no more cursors than numbers.
    """
    names = {level: f"next_{level.lower()}" for level in LEVELS}
    cell = ["source", "_bucket"]
    asked = cursors.select("source", F.col("after").cast("bigint").alias("idx"), F.lit(True).alias("_asks"),
                           *[F.lit(None).cast("bigint").alias(n) for n in names.values()]).where("idx is not null").distinct()
    leveled = df.where(F.col("level").isNotNull()).select(
        "source", F.col("idx").cast("bigint").alias("idx"), F.lit(False).alias("_asks"),
        *[F.when(F.col("level") == level, F.col("idx")).cast("bigint").alias(n) for level, n in names.items()])
    rows = asked.unionByName(leveled).withColumn("_bucket", bucket_of("idx", bucket))
    behind = W.partitionBy("source").orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    later = (rows.groupBy(*cell).agg(*[F.min(n).alias(n) for n in names.values()])
             .select(*cell, *[F.min(n).over(behind).alias(f"_later_{n}") for n in names.values()]))
    # A record with the cursor's own number comes after it, so it is not behind the cursor.
    inside = W.partitionBy(*cell).orderBy(F.desc("idx"), F.desc("_asks")).rowsBetween(W.unboundedPreceding, -1)
    near = rows.select(*cell, "idx", "_asks", *[F.min(n).over(inside).alias(n) for n in names.values()]).where("_asks")
    found = join_cells(near, later, cell).select(
        F.col("source").alias("_source"), F.col("idx").alias("_after"),
        *[F.coalesce(n, f"_later_{n}").alias(n) for n in names.values()])
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("after") == F.col("_after"))
    return cursors.join(found, same, "left").drop("_source", "_after")


def last_record(df: DataFrame) -> DataFrame:
    """The last record of each source; only one candidate per task and source is shuffled."""
    columns = [c for c in df.columns if c != "source"]
    return (df.groupBy("source").agg(F.max_by(F.struct(*columns), "idx").alias("_last"))
            .select("source", "_last.*"))


def tail_n(df: DataFrame, n: int, source: str | None = None) -> DataFrame:
    """Newest n records in file order: of one source, or of the whole table by record number."""
    view = df if source is None else df.where(F.col("source") == source)
    return view.orderBy(F.desc("idx"), F.desc("source")).limit(n).orderBy("idx", "source")
