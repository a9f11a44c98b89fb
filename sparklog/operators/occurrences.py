"""Where a literal stands in whole files, across lines and file splits.

Each split is searched once, alone. What runs over its border is found from the few bytes next to the borders,
which are kept as one small row per split.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .. import scratch
from ..sources.files import scan_units
from .blocks import _byte_order_mark, _unnumbered_runs, is_compressed

_SEARCHED = pa.schema([("source", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("size", pa.int64()),
                       ("bytes", pa.int64()), ("head", pa.binary()), ("tail", pa.binary())])
_FOUND = pa.schema([("source", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])
_ROWS = 65_536


def _hits(text: bytes, needle: bytes) -> list[int]:
    """Every place, overlapping ones too."""
    found, at = [], text.find(needle)
    while at >= 0:
        found.append(at)
        at = text.find(needle, at + 1)
    return found


def _last(text: bytes, n: int) -> bytes:
    return text[max(0, len(text) - n):]


def _search_blocks(needle: bytes):
    """Hits inside of each split, ``at`` counted from its first line, and one row of its borders."""
    keep = len(needle) - 1

    def hits_of(key, at: list[int], before: int) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(at), _ROWS):
            part = np.array(at[lo:lo + _ROWS], np.int64) + before
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(key[0]), n), pa.repeat(pa.scalar(key[1], pa.int64()), n), pa.array(part),
                 *[pa.nulls(n, f.type) for f in list(_SEARCHED)[3:]]], schema=_SEARCHED)

    def border(key, size, done, head, tail) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(
            _SEARCHED.names, (key[0], key[1], None, size, done, head, tail)))], schema=_SEARCHED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, size, done, head, tail = None, None, 0, b"", b""
        for batch in batches:
            for lo, hi in _unnumbered_runs(batch):
                here = batch.column("source")[lo].as_py(), batch.column("block")[lo].as_py()
                if here != key:
                    if key:
                        yield border(key, size, done, head, tail)
                    key, size, done, head, tail = here, batch.column("size")[lo].as_py(), 0, b"", b""
                lines = batch.column("value").slice(lo, hi - lo).to_pylist()
                lines.append(b"")
                text = tail + b"\n".join(lines)
                yield from hits_of(key, _hits(text, needle), done - len(tail))
                done += len(text) - len(tail)
                if len(head) < keep:
                    # Until the head is full, the tail holds all there was.
                    head = text[:keep]
                tail = _last(text, keep)
        if key:
            yield border(key, size, done, head, tail)

    return run


def _search_borders(needle: bytes):
    """Hits that run over the border in front of a split; the rows of a source come in file order."""
    keep = len(needle) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, before = None, b""
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row["source"] != source:
                    source, before = row["source"], b""
                for at in _hits(before + row["head"], needle):
                    if at < len(before) < at + len(needle):
                        found.append({"source": source, "offset": row["offset"] - len(before) + at,
                                      "size": row["size"]})
                before = _last(before + row["tail"], keep)
            yield pa.RecordBatch.from_pylist(found, schema=_FOUND)

    return run


def find_in_units(units: DataFrame, literal: str) -> DataFrame:
    """``source`` and byte ``offset`` of every place where ``literal`` stands in the lines of ``units``, over line
    breaks and splits too, overlapping places as well.

    The files are read once; hits and borders are written to the shared folder. No two tasks need the same text, and a
    source of any size sends one row per split, of twice the literal's length, through the pass over borders. Null
    lines are empty ones. The end of a file without a break holds none, but for compressed files, whose true length
    isn't known.
    """
    if not literal:
        raise ValueError("the literal must not be empty")
    needle = literal.encode()
    lines = units.select("source", "block", "size", F.coalesce("value", F.lit("")).cast("binary").alias("value"))
    searched = scratch.write_table(lines.mapInArrow(
        _search_blocks(needle), "source string, block bigint, at bigint, size bigint, bytes bigint, head binary, tail binary"),
        "occurrences")
    borders = searched.where("bytes is not null")
    earlier = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    mark = _byte_order_mark(F.sum("bytes").over(W.partitionBy("source")), 1)
    borders = borders.withColumn("offset", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)) + mark)
    small = borders.select("source", "block", "offset", "size")
    n_blocks = borders.count()
    small = F.broadcast(small) if n_blocks <= scratch.MAX_BROADCAST_ROWS else small.hint("shuffle_hash")
    inside = (searched.where("at is not null").select("source", "block", "at").join(small, ["source", "block"])
              .select("source", (F.col("offset") + F.col("at")).alias("offset"), "size"))
    over = (borders.select("source", "block", "offset", "size", "head", "tail").repartition("source")
            .sortWithinPartitions("source", "block")
            .mapInArrow(_search_borders(needle), "source string, offset bigint, size bigint"))
    found = inside.unionByName(over)
    whole = F.col("offset") + len(needle) <= F.col("size")
    return found.where(whole | is_compressed(F.col("source"))).select("source", "offset")


def occurrences_in_files(spark: SparkSession, path, literal: str) -> DataFrame:
    """``find_in_units`` over files in UTF-8; offsets are those of the bytes of the file."""
    return find_in_units(scan_units(spark, path), literal)
