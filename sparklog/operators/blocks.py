"""Record numbers, byte offsets and record boundaries over file splits.

All three are prefix scans over the lines of a file. They are done in two levels so that no
text is shuffled or sorted: each split ("block") is first reduced to one row of numbers, a
window over those few rows tells every block how it starts, and a second scan finishes each
block on its own. Inside a task the lines of a block arrive in file order and next to each
other, so the second level is a running sum over Arrow batches.

The input of every function here is a "unit" table with at least
``source, block, size, width`` and ``value``: one row per line (or per piece between two
separators), ``width`` being its bytes including the separator.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_schema

from .. import scratch

_KEY = ["source", "block"]


def is_compressed(source: Column) -> Column:
    """The size of a compressed file says nothing about its text."""
    return source.rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate)\z")


# ---------------------------------------------------------------- helpers inside of tasks

def _ranges(change: np.ndarray) -> list[tuple[int, int]]:
    first = np.flatnonzero(change)
    return list(zip(first.tolist(), first[1:].tolist() + [len(change)]))


def _runs(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    """Row ranges of a batch that belong to one numbered block each."""
    block = batch.column("block_no").to_numpy()
    change = np.ones(len(block), bool)
    change[1:] = block[1:] != block[:-1]
    return _ranges(change)


def _unnumbered_runs(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    """The same before blocks have numbers."""
    n = batch.num_rows
    source, block = batch.column("source"), batch.column("block").to_numpy()
    change = np.ones(n, bool)
    if n > 1:
        other = pc.not_equal(source.slice(1), source.slice(0, n - 1))
        change[1:] = other.to_numpy(zero_copy_only=False) | (block[1:] != block[:-1])
    return _ranges(change)


def _flags(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(bool)


class _Check:
    """Compares the bytes of each block with those that its table row has."""

    def __init__(self):
        self.block, self.seen, self.expected = None, 0, 0

    def add(self, batch: pa.RecordBatch) -> None:
        width, expected = batch.column("width").to_numpy(), batch.column("expected")
        block = batch.column("block_no")
        for lo, hi in _runs(batch):
            if block[lo].as_py() != self.block:
                self.finish()
                self.block, self.seen = block[lo].as_py(), 0
                self.expected = expected[lo].as_py()
            self.seen += int(width[lo:hi].sum())

    def finish(self) -> None:
        if self.seen != self.expected:
            raise ValueError(_MOVED)


def _key(batch: pa.RecordBatch, row: int) -> tuple[str, int]:
    return batch.column("source")[row].as_py(), batch.column("block")[row].as_py()


# ------------------------------------------------------------------- numbering of units

def _running_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the sums of ``weight`` and ``width`` over the block's earlier rows."""
    block, carry, check = None, (0, 0), _Check()
    for batch in batches:
        check.add(batch)
        runs = _runs(batch)
        if not runs:
            continue
        blocks = batch.column("block_no").to_numpy()
        sums, ends = [], []
        for name, start in (("weight", carry[0]), ("width", carry[1])):
            amount = batch.column(name).to_numpy().astype(np.int64)
            before = np.cumsum(amount) - amount
            for n_run, (lo, hi) in enumerate(runs):
                first = start if n_run == 0 and blocks[0] == block else 0
                before[lo:hi] += first - before[lo]
            sums.append(pa.array(before))
            ends.append(int(before[-1] + amount[-1]))
        block, carry = blocks[-1], tuple(ends)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *sums], names=[*batch.schema.names, "idx", "offset"])
    check.finish()


def _byte_order_mark(total: Column, separator_bytes: int) -> Column:
    """3 when the scan dropped a UTF-8 byte order mark: the lines then miss three bytes."""
    missing = F.col("size") - total
    return F.when(missing.isin(3, 3 - separator_bytes) & ~is_compressed(F.col("source")),
                  F.lit(3)).otherwise(F.lit(0))


def _origin(blocks: DataFrame, origin: DataFrame | None) -> DataFrame:
    """Start values per source: zero, or where an earlier micro-batch stopped."""
    if origin is None:
        return blocks.withColumns({"idx0": F.lit(0).cast("bigint"),
                                   "offset0": F.lit(0).cast("bigint")})
    start = origin.select("source", F.col("next_idx").alias("idx0"),
                          F.col("next_offset").alias("offset0"))
    return (blocks.join(start, "source", "left")
            .withColumns({"idx0": F.coalesce("idx0", F.lit(0)),
                          "offset0": F.coalesce("offset0", F.lit(0))}))


_MOVED = ("the files were split in another way than when their blocks were written; "
          "keep spark.sql.files.* and the files as they are between the two reads")


def _place(units: DataFrame, blocks: DataFrame, n_blocks: int, *columns: str,
           some: bool = False) -> DataFrame:
    """Put the number of its block, and ``columns``, in the place of a unit's source and block,
    keeping units of a block together in order. Paths need not pass through Python then.

    Both scans must split the files alike. A unit of an unknown block is an error, and
    ``expected`` lets the task compare the bytes of each block; with ``some`` the table has
    chosen blocks only, and units of others are left out.

    The block table was counted. Up to the broadcast bound the scan is not moved at all;
    beyond it units and blocks meet by a shuffle on the block, which no hot source can skew
    because a block is one file split, and are put back into file order.
    """
    small = blocks.select(*_KEY, "block_no", F.col("bytes").alias("expected"), *columns)
    how = "inner" if some else "left"
    known = F.coalesce("block_no", F.raise_error(F.lit(_MOVED)).cast("bigint")).alias("block_no")
    kept = [known, "expected", *columns,
            *[c for c in units.columns if c not in (*_KEY, "size")]]
    if n_blocks <= scratch.MAX_BROADCAST_ROWS:
        return units.join(F.broadcast(small), _KEY, how).select(*kept)
    ordered = units.withColumn("_order", F.monotonically_increasing_id())
    return (ordered.join(small.hint("shuffle_hash"), _KEY, how)
            .sortWithinPartitions("block_no", "_order").select(*kept))


def _restore(rows: DataFrame, blocks: DataFrame, n_blocks: int, *columns: str) -> DataFrame:
    """Source and true numbers of rows that carry numbers relative to their block."""
    small = blocks.select("block_no", "source", F.col("idx").alias("_idx0"),
                          F.col("offset").alias("_offset0"), *columns)
    small = F.broadcast(small) if n_blocks <= scratch.MAX_BROADCAST_ROWS else \
        small.hint("shuffle_hash")
    return (rows.join(small, "block_no")
            .withColumns({"idx": F.col("idx") + F.col("_idx0"),
                          "offset": F.col("offset") + F.col("_offset0")})
            .drop("block_no", "expected", "_idx0", "_offset0"))


def _write_blocks(blocks: DataFrame) -> DataFrame:
    return scratch.write_table(
        blocks.withColumn("block_no", F.monotonically_increasing_id()), "blocks")


def number_blocks(units: DataFrame, separator_bytes: int = 1,
                  origin: DataFrame | None = None) -> DataFrame:
    """One written row per block: first record number (summing ``weight``) and byte offset."""
    blocks = units.groupBy(*_KEY).agg(
        F.max("size").alias("size"), F.sum("weight").alias("n"), F.sum("width").alias("bytes"))
    earlier = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("source")
    mark = _byte_order_mark(F.sum("bytes").over(whole), separator_bytes)
    return _write_blocks(_origin(blocks, origin).select(
        *_KEY, "size", "n", "bytes",
        (F.col("idx0") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("idx"),
        (F.col("offset0") + F.coalesce(F.sum("bytes").over(earlier), F.lit(0))
         + (mark if origin is None else F.lit(0))).alias("offset")))


def number_units(units: DataFrame, blocks: DataFrame) -> DataFrame:
    """Add ``idx`` (records before the unit) and byte ``offset`` to each unit."""
    n_blocks = blocks.count()
    placed = _place(units.withColumns({"width": F.col("width").cast("int"),
                                       "weight": F.col("weight").cast("int")}), blocks, n_blocks)
    schema = T.StructType([*placed.schema.fields, T.StructField("idx", T.LongType()),
                           T.StructField("offset", T.LongType())])
    return _restore(placed.mapInArrow(_running_sums, schema), blocks, n_blocks, "size")


# --------------------------------------------------------- records made of several lines

_SUMMARY = pa.schema([
    ("source", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()),
    ("starts0", pa.int64()), ("starts1", pa.int64()), ("toggles", pa.int64()),
    ("lead", pa.bool_()), ("out", pa.int32()), ("header", pa.string())])


class _Summary:
    """Numbers of one block, gathered while its lines stream by."""

    def __init__(self, key, size, quoted, header):
        self.row = dict(source=key[0], block=key[1], size=size, bytes=0, starts0=0, starts1=0,
                        toggles=0, lead=None, out=None, header=None)
        self.quoted = quoted
        self.awaits_header = header and key[1] == 0

    def add(self, batch: pa.RecordBatch) -> None:
        row = self.row
        row["bytes"] += int(batch.column("width").to_numpy().sum())
        if self.awaits_header:
            self.awaits_header = False
            head = batch.column("first").cast(pa.binary())[0].as_py()
            row["header"] = head.decode("utf-8", "replace")
            batch = batch.slice(1)
            if batch.num_rows == 0:
                return
        start = _flags(batch, "start")
        if self.quoted:
            parity = (row["toggles"] + np.cumsum(start) - start) % 2
            row["starts0"] += int((parity == 0).sum())
            row["starts1"] += int((parity == 1).sum())
            row["toggles"] += int(start.sum())
            return
        if row["lead"] is None:
            row["lead"] = not bool(start[0])
        row["starts0"] += int(start.sum())
        row["starts1"] = row["starts0"]
        close = _flags(batch, "close")
        at = np.flatnonzero(start)
        if len(at):
            row["out"] = 0 if close[at[-1]:].any() else 1
        elif close.any():
            row["out"] = 0


def _summarise(quoted: bool, header: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, current, done = None, None, []
        for batch in batches:
            for lo, hi in _unnumbered_runs(batch):
                if _key(batch, lo) != key:
                    if current:
                        done.append(current.row)
                    key = _key(batch, lo)
                    current = _Summary(key, batch.column("size")[lo].as_py(), quoted, header)
                current.add(batch.slice(lo, hi - lo))
            if len(done) > 1000:
                yield pa.RecordBatch.from_pylist(done, _SUMMARY)
                done = []
        if current:
            done.append(current.row)
        yield pa.RecordBatch.from_pylist(done, _SUMMARY)
    return run


_PIECES = pa.schema([
    ("block_no", pa.int64()), ("idx", pa.int64()), ("offset", pa.int64()),
    ("length", pa.int64()), ("raw", pa.string())])

# How a block begins and ends, as bits of one number.
_OPEN_HEAD, _OPEN_TAIL, _NO_LAST_BREAK, _HEADER = 1, 2, 4, 8


class _Gluer:
    """Joins the lines of one block to records; keeps only the record that is still open.
    Numbers and offsets count from the begin of the block."""

    def __init__(self, block_no: int, flags: int, quoted: bool, parts: bool):
        self.block_no, self.flags = block_no, flags
        self.quoted, self.parts = quoted, parts
        self.open_head = bool(flags & _OPEN_HEAD)
        self.skip_first = bool(flags & _HEADER)
        self.toggles, self.offset = int(self.open_head), 0
        # The head belongs to the record before this block's first one; without an open
        # record in front of the block it is no record's text.
        self.open_idx, self.in_head = -1, True
        self.open_from, self.open_bytes, self.open_text = 0, 0, []
        self.open_closed = not quoted and not self.open_head

    def _row(self, idx, offset, length, raw):
        return pa.record_batch(
            [pa.repeat(pa.scalar(self.block_no, pa.int64()), len(idx)),
             pa.array(idx, pa.int64()), pa.array(offset, pa.int64()),
             pa.array(length, pa.int64()), raw], schema=_PIECES)

    def _extend(self, values, width, close) -> None:
        """Append lines to the open record, up to the line that closes it."""
        if self.open_closed or not len(width):
            return
        if close is not None and close.any():
            self.open_closed = True
            end = int(np.argmax(close)) + 1
            values, width = values.slice(0, end), width[:end]
        self.open_bytes += int(width.sum())
        self.open_text.append(values)

    def _flush(self, at_block_end: bool):
        """The record that was open: a whole record, or a part when it crosses the block."""
        part = self.in_head or (at_block_end and bool(self.flags & _OPEN_TAIL))
        if part != self.parts or (self.in_head and not (self.open_head and self.open_bytes)):
            return None
        lines = pa.concat_arrays(self.open_text) if self.open_text else pa.array([], pa.string())
        whole = pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines)
        text = pc.binary_join(whole, "\n")
        return self._row([self.open_idx], [self.open_from], [self.open_bytes], text)

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        width = batch.column("width").to_numpy().astype(np.int64)
        if self.skip_first:
            self.skip_first = False
            self.offset += int(width[0])
            batch, width = batch.slice(1), width[1:]
        if not len(width):
            return
        values, start, close = batch.column("value"), _flags(batch, "start"), None
        if self.quoted:
            parity = (self.toggles + np.cumsum(start) - start) % 2
            self.toggles = int(self.toggles + start.sum()) % 2
            start = parity == 0
        else:
            close = _flags(batch, "close")
        at = np.flatnonzero(start)
        ends = np.cumsum(width)
        lead = int(at[0]) if len(at) else len(width)
        self._extend(values.slice(0, lead), width[:lead], None if close is None else close[:lead])
        if not len(at):
            self.offset += int(ends[-1])
            return
        flushed = self._flush(at_block_end=False)
        if flushed:
            yield flushed
        first_idx = self.open_idx + 1
        line_offset = self.offset + ends - width
        # All groups but the last one are known to be whole.
        if len(at) > 1 and not self.parts:
            yield self._groups(values, width, close, at, first_idx, line_offset)
        last = int(at[-1])
        self.in_head, self.open_idx = False, first_idx + len(at) - 1
        self.open_from, self.open_bytes = int(line_offset[last]), 0
        self.open_text, self.open_closed = [], False
        self._extend(values.slice(last), width[last:], None if close is None else close[last:])
        self.offset += int(ends[-1])

    def _groups(self, values, width, close, at, first_idx, line_offset) -> pa.RecordBatch:
        lo, hi = int(at[0]), int(at[-1])
        values, width = values.slice(lo, hi - lo), width[lo:hi]
        at = at - lo
        offset = line_offset[lo:hi][at[:-1]]
        idx = np.arange(first_idx, first_idx + len(at) - 1)
        bounds, n_rows = at, hi - lo
        if close is not None and close[lo:hi].any():
            closed = np.cumsum(close[lo:hi]) - close[lo:hi]
            group = np.repeat(np.arange(len(at) - 1), np.diff(at))
            keep = closed == closed[at[:-1]][group]
            values, width, group = values.filter(pa.array(keep)), width[keep], group[keep]
            bounds = np.searchsorted(group, np.arange(len(at)))
            n_rows = len(width)
        length = np.add.reduceat(width, bounds[:-1])
        if n_rows == len(idx):
            raw = values
        else:
            raw = pc.binary_join(
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values), "\n")
        return self._row(idx, offset, length, raw)

    def finish(self):
        if self.flags & _NO_LAST_BREAK and self.open_bytes and not self.open_closed:
            self.open_bytes -= 1
        return self._flush(at_block_end=True)


def _glue(quoted: bool, parts: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gluer, check = None, _Check()
        for batch in batches:
            check.add(batch)
            for lo, hi in _runs(batch):
                block_no = batch.column("block_no")[lo].as_py()
                if gluer is None or gluer.block_no != block_no:
                    last = gluer and gluer.finish()
                    if last:
                        yield last
                    flags = batch.column("flags")[lo].as_py()
                    gluer = _Gluer(block_no, flags, quoted, parts)
                yield from gluer.add(batch.slice(lo, hi - lo))
        check.finish()
        last = gluer and gluer.finish()
        if last:
            yield last
    return run


def _start_states(summary: DataFrame, quoted: bool, origin: DataFrame | None,
                  hold_open: bool) -> DataFrame:
    """How each block begins: inside of a record or not, first record number, byte offset."""
    ordered = W.partitionBy("source").orderBy("block")
    earlier = ordered.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("source")
    if quoted:
        df = summary.withColumn("state", F.coalesce(F.sum("toggles").over(earlier), F.lit(0)) % 2)
        df = df.withColumns({
            "n": F.when(F.col("state") == 0, F.col("starts0")).otherwise(F.col("starts1")),
            "open_tail": (F.col("state") + F.col("toggles")) % 2 == 1})
        unfinished = F.sum("toggles").over(whole) % 2 == 1
    else:
        df = summary.withColumn(
            "state", F.coalesce(F.last("out", ignorenulls=True).over(earlier), F.lit(0)))
        df = df.withColumns({
            "n": F.col("starts0"),
            "open_tail": (F.coalesce("out", "state") == 1)
            & F.coalesce(F.lead("lead").over(ordered), F.lit(hold_open))})
        # The end of a file ends its last record, the end of a micro-batch does not.
        unfinished = F.last(F.coalesce("out", "state")).over(
            ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) == F.lit(
            1 if hold_open else -1)
    total = F.sum("bytes").over(whole)
    mark = _byte_order_mark(total, 1)
    # Without a final line break the lines count one byte more than the file has.
    cut = (F.lead("block").over(ordered).isNull() & (total - F.col("size")).isin(1, -2)
           & ~is_compressed(F.col("source"))) if origin is None else F.lit(False)
    df = _origin(df, origin)
    return df.select(
        *_KEY, "size", "header", "n", "bytes", F.col("state").cast("int").alias("state"), "open_tail",
        (F.col("idx0") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("idx"),
        (F.col("offset0") + F.coalesce(F.sum("bytes").over(earlier), F.lit(0))
         + (mark if origin is None else F.lit(0))).alias("offset"),
        cut.cast("int").alias("tail_cut"),
        F.when(unfinished, F.col("idx0") + F.sum("n").over(whole) - 1).alias("unfinished_idx"),
        F.first("header", ignorenulls=True).over(
            ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("file_header"),
    )


def index_blocks(units: DataFrame, quoted: bool, header: bool, origin: DataFrame | None = None,
                 hold_open: bool = False) -> DataFrame:
    """One written row per block. Only flags and sizes go through Python, and for the first
    block of a file the text that may be its header line.

    ``hold_open`` treats the record at the end as unfinished unless something closed it.
    """
    first = F.when(F.col("block") == 0, F.col("value")) if header else F.lit(None).cast("string")
    close = F.col("close") if "close" in units.columns else F.lit(False)
    narrow = units.select(*_KEY, "size", F.col("width").cast("int").alias("width"), "start",
                          close.alias("close"), first.alias("first"))
    summary = narrow.mapInArrow(_summarise(quoted, header), from_arrow_schema(_SUMMARY))
    return _write_blocks(_start_states(summary, quoted, origin, hold_open))


def glue_records(units: DataFrame, blocks: DataFrame, quoted: bool, header: bool) -> DataFrame:
    """Records as ``source, idx, offset, length, raw, layout``.

    ``quoted`` reads ``start`` as "this line has an odd number of quotes"; otherwise ``start``
    opens a record and ``close`` ends it. Records inside of a block never move. Only records
    that cross a block are cut into parts, at most two per block, and meet in a shuffle. A
    record may be as long as one string can be (2 GB); a longer one is an error.
    """
    n_blocks, n_crossing = blocks.agg(
        F.count("*"), F.count_if(F.expr(_CROSSING))).first()
    whole = _run_glue(units, blocks, n_blocks, quoted, header, False)
    if not n_crossing:
        return whole
    return whole.unionByName(_stitched(units, blocks, n_blocks, quoted, header, "left_anti"))


def unfinished_records(units: DataFrame, blocks: DataFrame, quoted: bool,
                       header: bool) -> DataFrame:
    """The record that is still open at the end of each source."""
    return _stitched(units, blocks, blocks.count(), quoted, header, "left_semi")


_CROSSING = "open_tail or state = 1"


def _unfinished(blocks: DataFrame) -> DataFrame:
    return (blocks.where("unfinished_idx is not null")
            .select("source", F.col("unfinished_idx").alias("idx")).distinct())


def _run_glue(units, blocks, n_blocks, quoted, header, parts) -> DataFrame:
    if "layout" not in blocks.columns:
        blocks = blocks.withColumn("layout", F.lit(0).cast("bigint"))
    first = F.lit(_HEADER if header else 0)
    blocks = blocks.withColumn("flags", (
        F.col("state") * _OPEN_HEAD + F.col("open_tail").cast("int") * _OPEN_TAIL
        + F.col("tail_cut") * _NO_LAST_BREAK
        + F.when(F.col("block") == 0, first).otherwise(F.lit(0))).cast("int"))
    close = F.col("close") if "close" in units.columns else F.lit(False)
    narrow = units.select(*_KEY, F.col("width").cast("int").alias("width"), "value", "start",
                          close.alias("close"))
    glued = _place(narrow, blocks, n_blocks, "flags", some=parts).mapInArrow(
        _glue(quoted, parts), from_arrow_schema(_PIECES))
    columns = ("layout", "block") if parts else ("layout",)
    return _restore(glued, blocks, n_blocks, *columns).select(
        "source", "idx", "offset", "length", "raw", *columns)


def _stitched(units, blocks, n_blocks, quoted, header, unfinished: str) -> DataFrame:
    """Records that cross a block, put together from their parts.

    Records that are never finished are known from the block table. They are left out, or only
    they are taken (``unfinished`` is the kind of join), before any text is gathered.
    """
    parts = _run_glue(units, blocks.where(_CROSSING), n_blocks, quoted, header, True)
    return (
        parts.where("idx >= 0").join(_unfinished(blocks), ["source", "idx"], unfinished)
        .groupBy("source", "idx")
        .agg(F.min("offset").alias("offset"), F.sum("length").alias("length"),
             F.array_sort(F.collect_list(F.struct("block", "raw"))).alias("pieces"),
             F.first("layout").alias("layout"))
        .select("source", "idx", "offset", "length",
                F.array_join(F.transform("pieces", lambda p: p["raw"]), "\n").alias("raw"),
                "layout"))


def clamp_length(length: Column, size: Column) -> Column:
    """The last line may have no separator; its length then ends with the file."""
    return F.when(is_compressed(F.col("source")), length).otherwise(
        F.least(length, size - F.col("offset")))
