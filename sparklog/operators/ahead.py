"""Lines with the text of the lines that follow them, over file splits."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .. import scratch
from .blocks import _unnumbered_runs

#: First lines of splits are broadcast up to this size together.
MAX_BROADCAST_BYTES = 64 << 20
_HEADS = pa.schema([("source", pa.string()), ("block", pa.int64()), ("lines", pa.list_(pa.binary()))])


def _first_lines(n: int):
    """One row per split with its first ``n`` lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lines = None, []

        def head():
            return pa.RecordBatch.from_pylist([{"source": key[0], "block": key[1], "lines": lines}], schema=_HEADS)

        for batch in batches:
            for lo, hi in _unnumbered_runs(batch):
                here = batch.column("source")[lo].as_py(), batch.column("block")[lo].as_py()
                if here != key:
                    if key:
                        yield head()
                    key, lines = here, []
                if len(lines) < n:
                    lines += batch.column("value").slice(lo, min(hi - lo, n - len(lines))).to_pylist()
        if key:
            yield head()

    return run


def _lines_behind(n: int):
    """Adds ``_ahead``, the next ``n`` lines of the same split, and ``_lack``, how many of them it has not."""
    def placed(batch: pa.RecordBatch, lo: int, hi: int, stop: int) -> pa.RecordBatch:
        """Rows ``lo`` to ``stop`` of a split whose rows here are ``lo`` to ``hi``."""
        lines = batch.column("value").cast(pa.binary()).slice(lo, hi - lo).to_pylist()
        behind = [lines[i + 1:i + 1 + n] for i in range(stop - lo)]
        ahead = pa.array([b"\n".join(x) if x else None for x in behind], pa.binary())
        lack = pa.array([n - len(x) for x in behind], pa.int32())
        rows = batch.slice(lo, stop - lo)
        return pa.RecordBatch.from_arrays([*rows.columns, ahead, lack], names=[*rows.schema.names, "_ahead", "_lack"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            *whole, last = _unnumbered_runs(batch)
            for lo, hi in whole:
                yield placed(batch, lo, hi, hi)
            lo, hi = last
            stop = max(lo, hi - n)
            if stop > lo:
                yield placed(batch, lo, hi, stop)
            held = batch.slice(stop, hi - stop)
        if held is not None:
            yield placed(held, 0, held.num_rows, held.num_rows)

    return run


def with_lines_ahead(units: DataFrame, n: int) -> DataFrame:
    """Adds ``ahead``, the next ``n`` lines of the file, fewer at its end, joined by line breaks.

    Only the first lines of each split travel to the split before it. They are written, and broadcast if their
    counted rows and bytes allow it; else splits meet them by a shuffle on the split and are put back in order.
    """
    text = units.withColumn("value", F.coalesce("value", F.lit("")))
    heads = scratch.write_table(
        text.select("source", "block", F.col("value").cast("binary").alias("value"))
        .mapInArrow(_first_lines(n), "source string, block bigint, lines array<binary>"), "heads")
    heads = heads.withColumn("lines", F.transform("lines", lambda x: x.cast("string")))
    follow = W.partitionBy("source").orderBy("block").rowsBetween(1, n)
    behind = heads.select("source", "block", F.slice(F.flatten(F.collect_list("lines").over(follow)), 1, n).alias("_behind"))
    size = heads.agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.array_join("lines", "\n"))).alias("bytes")).first()
    small = size["rows"] <= scratch.MAX_BROADCAST_ROWS and n * (size["bytes"] or 0) <= MAX_BROADCAST_BYTES
    schema = T.StructType([*text.schema.fields, T.StructField("_ahead", T.BinaryType()), T.StructField("_lack", T.IntegerType())])
    near = text.mapInArrow(_lines_behind(n), schema)
    if small:
        joined = near.join(F.broadcast(behind), ["source", "block"], "left")
    else:
        joined = (near.withColumn("_order", F.monotonically_increasing_id())
                  .join(behind.hint("shuffle_hash"), ["source", "block"], "left")
                  .sortWithinPartitions("source", "block", "_order"))
    rest = F.when(F.col("_lack") > 0, F.slice("_behind", F.lit(1), F.col("_lack")))
    return joined.select(*units.columns, F.concat_ws("\n", F.col("_ahead").cast("string"), rest).alias("ahead"))
