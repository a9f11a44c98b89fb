"""Sharding by an external shuffle in two passes, with functions of the JVM only.

Pass one scatters whole records into buckets by a seeded hash; a bucket is one partition of the
exchange and small enough for memory. Pass two puts each bucket in order of the hashes, shuffles it by
Fisher-Yates (``shuffle`` with a seed) and writes it. Buckets one after another are one random order of
all records, and shards are equal stretches of it: counts differ by one at most.

A record's hash has its place in the scan besides its contents, so that equal records, and records that
share an id or lack one, spread over all buckets. The same files read in the same splits give the
same order again, also after a lost executor; read in other splits they give another one.

Bucket size: ``bucket_bytes`` of text on average, and as many buckets as that needs, but
``most_buckets`` at most, beyond which buckets grow (at 100 TB to 1 GB with the defaults; give
executors six times a bucket per core then). A bucket holds at least one record, however long.

Defined results: a null text has no bytes and the CRC of an empty text; repeated rows are records of their own;
ids may be null; records keep all their columns, whatever their names; an empty table gives
empty shards.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import scratch

#: Bytes that a record takes besides its text.
_BESIDES = 8


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + _BESIDES).cast("long")


def external_shuffle(docs: DataFrame, text: str = "text", seed: int = 12, bucket_bytes: int = 16 << 20,
                     most_buckets: int = 100_000) -> DataFrame:
    """All rows of ``docs`` as the struct ``record``, with ``bucket`` and ``rank``, its place in the shuffled
    bucket: a written table."""
    total = docs.agg(F.sum(record_size(F.col(f"`{text}`")))).first()[0] or 0
    buckets = max(1, min(most_buckets, -(-total // bucket_bytes)))
    contents = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    key = F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), *contents)
    rows = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"))
    # Low bits choose the bucket; the order inside goes by a hash of the key.
    scattered = (rows.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
                 .withColumn("key", F.xxhash64(F.lit(seed + 1), "key"))
                 .repartitionById(buckets, F.col("bucket")))
    in_order = F.array_sort(F.collect_list(F.struct("key", "record")), lambda a, b: F.when(
        a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    shuffled = scattered.groupBy("bucket").agg(in_order.alias("rows")).select(
        "bucket", F.posexplode(F.shuffle("rows", seed)).alias("rank", "row"))
    return scratch.write_table(shuffled.select("bucket", F.col("rank").cast("long").alias("rank"), "row.record"), "shuffled")


def shards(docs: DataFrame, n: int = 24, **options) -> DataFrame:
    """``docs`` as the struct ``record``, with ``shard`` (0 to n - 1) and ``slot``, gapless from 0 in each."""
    shuffled = external_shuffle(docs, **options)
    counts = scratch.write_table(shuffled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "buckets")
    # One row per bucket, which ``most_buckets`` bounds.
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
                           F.sum("n").over(W.partitionBy()).alias("all"))
    placed = shuffled.join(F.broadcast(starts), "bucket").withColumn("at", F.col("first") + F.col("rank"))
    # Shard s has the places from floor(s * all / n) on.
    placed = placed.withColumn("shard", F.expr(f"((at + 1) * {n} - 1) div all"))
    return placed.select("record", F.col("shard").cast("int").alias("shard"), F.expr(f"at - shard * all div {n}").alias("slot"))


def write_shards(docs: DataFrame, path: str, n: int = 24, **options) -> None:
    """Write ``docs`` as Parquet folders ``shard=0`` to ``shard=n-1``, in files that are stretches of slots."""
    placed = shards(docs, n, **options)
    (placed.select("record.*", "shard").write.partitionBy("shard").parquet(path))
