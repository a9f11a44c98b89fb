"""Dense numbers inside of groups of any size."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Rows of one group are numbered in buckets of this many index values.
BUCKET = 1 << 18


def bucket_of(order: str, bucket: int) -> Column:
    return F.expr(f"`{order}` div {bucket}")


def dense_number(df: DataFrame, keys: list[str], out: str, order: str = "idx",
                 bucket: int = BUCKET) -> DataFrame:
    """Number rows 0, 1, 2 ... per ``keys`` in the order of the integer column ``order``.

    A group may hold a large share of all rows, so it is cut into buckets of the order column:
    rows are numbered inside of a bucket, and a window over the few bucket counts gives each
    bucket its first number. Numbering and join use the same hash of keys and bucket, so the
    rows move once. Null keys are a group like any other.
    """
    cell = [*keys, "_bucket"]
    placed = df.withColumn("_bucket", bucket_of(order, bucket))
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (placed.groupBy(*cell).agg(F.count("*").alias("_n"))
              .select(*cell, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")))
    inside = F.row_number().over(W.partitionBy(*cell).orderBy(order)) - 1
    return (join_cells(placed.withColumn("_inside", inside), starts, cell)
            .withColumn(out, F.col("_start") + F.col("_inside"))
            .select(*df.columns, out))


def join_cells(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys of which null meets null."""
    other = cells.select(*[F.col(k).alias(f"_key_{k}") for k in keys],
                         *[c for c in cells.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return rows.join(other, same).drop(*[f"_key_{k}" for k in keys])
