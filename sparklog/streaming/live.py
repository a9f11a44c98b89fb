"""Running results over record streams, and the payload dump."""

from collections import deque
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import scratch
from ..operators.stats import level_counts


def dump_payloads(payloads: DataFrame, out: str, value: str = "value") -> DataStreamWriter:
    """Append each non-empty payload and a line break to text files below ``out``."""
    text = F.make_valid_utf8(F.col(value).cast("string"))
    return (payloads.where(F.octet_length(value) > 0).select(text.alias("value"))
            .writeStream.format("text").option("path", out).outputMode("append"))


def running_level_counts(records: DataFrame, *by: str) -> DataFrame:
    """Counts per level that never expire; write it in ``complete`` or ``update`` mode."""
    return level_counts(records, *by)


def running_status(segments: DataFrame) -> DataFrame:
    """Latest state per source: records so far and the end of the last one. Segments with the ``size`` of their file, as
    it was when they were read, also give the whole percent done and whether text is left behind."""
    end = F.col("offset") + F.col("length")
    state = segments.groupBy("source").agg(
        F.count("*").alias("count"), F.max(end).alias("end"),
        *([F.max("size").alias("size")] if "size" in segments.columns else []))
    if "size" not in segments.columns:
        return state
    return state.select("source", "count", "end", (F.col("end") < F.col("size")).alias("is_processing_saved_data"),
                        F.floor(100 * F.col("end") / F.col("size")).cast("int").alias("progress"))


def write_latest(result: DataFrame, out: str) -> DataStreamWriter:
    """Keep the newest full result readable: each micro-batch writes the whole result to its
    own folder, then a mark with its number, and ``read_latest`` takes the newest one that has a mark.
    The result before stays for those who are reading it; older ones go."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{out}/done/batch_id={batch_id}")
        for kind in ("done/", ""):
            scratch.remove_folder(spark, f"{out}/{kind}batch_id={batch_id - 2}")

    return result.writeStream.outputMode("complete").foreachBatch(write)


def read_latest(spark: SparkSession, out: str) -> DataFrame:
    """Newest result of ``write_latest``: the value any late reader sees first."""
    newest = spark.read.schema("id bigint, batch_id bigint").parquet(f"{out}/done").agg(F.max("batch_id")).first()[0]
    return spark.read.parquet(f"{out}/batch_id={newest}")


def write_level_index(records: DataFrame, out: str) -> DataStreamWriter:
    """Record numbers by level, one folder per level, so that a jump reads its level only."""
    return (records.where(F.col("level").isNotNull()).select("source", "level", "idx")
            .writeStream.format("parquet").partitionBy("level").option("path", out)
            .outputMode("append"))


class BatchCounts:
    """Rows of each micro-batch, as a function for ``foreachBatch``. A batch is counted while the stream goes on to the
    next ones, with ``ahead`` of them open at most. The engine may commit it before that, so this is for counts that live no longer
    than their stream: one that fails ends the stream or is raised by ``result``. A repeated batch counts once."""

    def __init__(self, ahead: int = 8):
        self.ahead, self.counts, self.pending = ahead, {}, deque()
        self.pool = ThreadPoolExecutor(ahead)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        while self.pending and (len(self.pending) >= self.ahead or self.pending[0].done()):
            self.pending.popleft().result()
        self.pending.append(self.pool.submit(self._count, batch, batch_id))

    def _count(self, batch: DataFrame, batch_id: int) -> None:
        # For batches made small by a bound: one task counts them without a shuffle.
        self.counts[batch_id] = batch.coalesce(1).count()

    def result(self) -> dict[int, int]:
        while self.pending:
            self.pending.popleft().result()
        return self.counts

    def close(self) -> None:
        self.pool.shutdown(cancel_futures=True)
