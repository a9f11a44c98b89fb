"""Scans of log files and directories."""

from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed value: characters of a file that format detection looks at.
DETECTION_CHARS = 4096


def scan_units(spark: SparkSession, path, separator: str = "\n", encoding: str = "UTF-8",
               head: int | None = None) -> DataFrame:
    """One row per piece between two separators, with its file, split and size in bytes.

    ``\\r`` stays in the value, so byte offsets and quoted line breaks survive. ``head`` keeps
    to the first pieces of each file, numbered in ``piece``, and does not read on.
    """
    if head is not None:
        return _head_units(spark, path, separator, encoding, head)
    text = F.col("value")
    # Bytes of one separator, without the mark that some encodings put in front.
    separator_bytes = len((separator * 2).encode(encoding)) - len(separator.encode(encoding))
    return (
        spark.read.option("lineSep", separator).option("encoding", encoding)
        .option("recursiveFileLookup", "true").text(path)
        .select(
            F.col("_metadata.file_path").alias("source"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("_metadata.file_size").alias("size"),
            (F.octet_length(text).cast("bigint") + separator_bytes).alias("width"),
            (text if encoding.upper() == "UTF-8"
             else F.decode(text.cast("binary"), encoding)).alias("value"),
        ))


def list_files(spark: SparkSession, path) -> DataFrame:
    """``source`` and ``size`` of every file; the content is not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select(F.col("_metadata.file_path").alias("source"), F.col("length").alias("size")))


def _open(source: str):
    parts = urlsplit(source)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    uri = source.replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(uri)


def _read_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = []
        for source in batch.column("source").to_pylist():
            system, name = _open(source)
            # A character takes four bytes at most.
            with system.open_input_stream(name) as stream:
                text = stream.read(4 * DETECTION_CHARS).decode("utf-8-sig", "replace")
            heads.append(text[:DETECTION_CHARS])
        yield pa.RecordBatch.from_arrays(
            [batch.column("source"), batch.column("size"), pa.array(heads, pa.string())],
            names=["source", "size", "head"])


def read_heads(spark: SparkSession, path) -> DataFrame:
    """First characters of every file, read by the tasks; the rest of a file is not touched."""
    return list_files(spark, path).mapInArrow(
        _read_heads, "source string, size bigint, head string")


# Size of a file that was not read to its end: nothing in it is known to be the last.
UNREAD = 1 << 62


def _head_units(spark: SparkSession, path, separator: str, encoding: str, head: int) -> DataFrame:
    end = separator.encode(encoding)

    def first_pieces(source: str, size: int):
        system, name = _open(source)
        chunks, chunk, found, last = [], b"-", 0, b""
        with system.open_input_stream(name) as stream:
            while chunk and found < head:
                chunk = stream.read(1 << 16)
                chunks.append(chunk)
                # Each chunk is searched once, with the end of the one before.
                last = last[len(last) - len(end) + 1:] if len(end) > 1 else b""
                found += (last + chunk).count(end)
                last += chunk
        text = b"".join(chunks)
        marked = text.startswith(b"\xef\xbb\xbf")
        *pieces, rest = text[3 * marked:].split(end)
        if not chunk and rest:
            pieces.append(rest)
        whole = not chunk and len(pieces) <= head
        return pieces[:head], size if whole else UNREAD

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, size in zip(*[batch.column(i).to_pylist() for i in range(2)]):
                pieces, known = first_pieces(source, size)
                n = len(pieces)
                yield pa.RecordBatch.from_arrays([
                    pa.repeat(pa.scalar(source), n), pa.repeat(pa.scalar(0, pa.int64()), n),
                    pa.repeat(pa.scalar(known, pa.int64()), n),
                    pa.array([len(x) + len(end) for x in pieces], pa.int64()),
                    pa.array([x.decode(encoding, "replace") for x in pieces], pa.string()),
                    pa.array(range(n), pa.int32())],
                    names=["source", "block", "size", "width", "value", "piece"])

    return list_files(spark, path).mapInArrow(
        read, "source string, block bigint, size bigint, width bigint, value string, piece int")
