"""A streaming source for files that grow.

Spark's file source reads each file once. This one remembers how many bytes of each file were
read, and hands out what was appended since, up to the last complete separator. Its rows are
units: ``source, block, size, width, value``.
"""

import json
import time
import zlib
from base64 import b64decode, b64encode
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_CHUNK = 1 << 20
_BYTE_ORDER_MARK = b"\xef\xbb\xbf"
_ROWS = 8192
# Of the records of one trigger a file gets an eighth at least, or as many as these.
_FILES_PER_TRIGGER = 8
_LEAST_SHARE = 4096
# With a bound in records a folder is listed anew when its known text is used up, or after this many times the
# time that the last listing took.
_LISTING_PAUSE = 20
# Key in an offset with a bound in records, no path. Its ``files`` are a packed table of positions that many offsets
# have in common, ``since`` those that moved since then (null for a file that is gone), and ``turn`` is the file that
# was counted last, behind which the next trigger goes on. Older offsets name every file, and have the turn here.
_TURN = ""
_LEAST_MOVED = 100
_SCHEMA = pa.schema([("source", pa.string()), ("block", pa.int64()), ("size", pa.int64()),
                     ("width", pa.int64()), ("value", pa.string())])


def _filesystem(path: str):
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, ""
    if path.startswith("file:"):
        local = "/" + path[len("file:"):].lstrip("/")
        return fs.LocalFileSystem(), local, ""
    system, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system, name, path[:len(path) - len(name)]


def _pack_positions(positions: dict[str, int]) -> str:
    text = json.dumps([list(positions), list(positions.values())]).encode()
    return b64encode(zlib.compress(text)).decode()


def _unpack_positions(packed: str) -> dict[str, int]:
    return dict(zip(*json.loads(zlib.decompress(b64decode(packed))))) if packed else {}


def _parts_of(offset: dict) -> tuple[str, dict, str | None]:
    """Packed table, later positions and turn of an offset."""
    inner = offset.get(_TURN)
    if isinstance(inner, dict):
        return inner["files"], inner["since"], inner["turn"]
    return "", {path: at for path, at in offset.items() if path != _TURN}, inner


class Range(InputPartition):
    """Bytes ``begin`` to ``end`` of a file; ``first`` says that a record starts at ``begin``."""

    def __init__(self, path, begin, end, first, size):
        self.path, self.begin, self.end, self.first, self.size = path, begin, end, first, size


class Ranges(InputPartition):
    """Several ranges for one task."""

    def __init__(self, ranges):
        self.ranges = ranges


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.separator = options.get("separator", "\n").encode()
        self.range_bytes = int(options.get("rangebytes", 64 << 20))
        self.open_cost = int(options["opencostbytes"]) if "opencostbytes" in options else None
        self.cap = int(options["maxbytespertrigger"]) if "maxbytespertrigger" in options else None
        self.max_records = int(options["maxrecordspertrigger"]) if "maxrecordspertrigger" in options else None
        if self.cap is not None and self.max_records is not None:
            raise ValueError("a trigger is bound by bytes or by records, not by both")
        if self.max_records is not None and self.max_records < 1:
            raise ValueError("maxRecordsPerTrigger must be positive")
        # How far batches were planned; none when a query begins. After a restart the engine asks for
        # the partitions of the last offset it has written before it asks for a new one.
        self.known: dict[str, int] | None = None
        # With a bound in records: the last offset's parts, and what the last listing found.
        self.packed, self.since, self.turn = "", {}, None
        self.tables: dict[str, dict[str, int]] = {"": {}}
        self.size: dict[str, int] = {}
        self.waiting: list[str] = []
        self.next_listing = 0.0

    def _files(self, system, root):
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            return [info]
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return [f for f in found if f.type == fs.FileType.File
                and not any(p.startswith((".", "_")) for p in f.path[len(root):].split("/"))]

    def initialOffset(self) -> dict:
        # Asked for after the first latest offset, so what is known stays.
        return {}

    def latestOffset(self) -> dict:
        system, root, _ = _filesystem(self.path)
        if self.max_records is not None:
            if self.known is None:
                self.known = {}
            self._count_records(system, root)
            return self._offset()
        latest = {}
        for info in self._files(system, root):
            size, floor = info.size, (self.known or {}).get(info.path, 0)
            if floor > size:
                floor = 0
            if floor == size:
                at = floor
            elif self.cap is not None:
                top = min(size, floor + self.cap)
                at = self._last_record_end(system, info.path, floor, top)
                if at == floor and top < size:
                    # One record is larger than the cap.
                    at = self._first_record_end(system, info.path, top, size, floor)
            else:
                at = self._last_record_end(system, info.path, floor, size)
            latest[info.path] = at
        self.known = latest
        return latest

    def _count_records(self, system, root) -> None:
        """Move on by ``max_records`` further records at most. The folder is listed when its known text doesn't
        suffice, and now and then."""
        left, fresh = self.max_records, not self.waiting or time.monotonic() >= self.next_listing
        if not fresh:
            left = self._take_records(system, left)
        if fresh or left:
            self._list(system, root)
            self._take_records(system, left)

    def _list(self, system, root) -> None:
        begin = time.monotonic()
        self.size = {f.path: f.size for f in self._files(system, root)}
        for path in self.known.keys() - self.size.keys():
            self._move(path, None)
        for path, size in self.size.items():
            # A shorter file was truncated or replaced.
            if self.known.get(path, size + 1) > size:
                self._move(path, 0)
        self.waiting = sorted(path for path, size in self.size.items() if self.known[path] < size)
        now = time.monotonic()
        self.next_listing = now + _LISTING_PAUSE * (now - begin)

    def _take_records(self, system, left: int) -> int:
        """Move on by ``left`` further records at most; the number of those that were not there. A few files with new
        text share the number evenly, and all files take turns from trigger to trigger, so that a trigger opens a few
        files, however many there are. What one does not need goes to the others."""
        least = max(_LEAST_SHARE, self.max_records // _FILES_PER_TRIGGER)
        behind = 0 if self.turn is None else bisect_right(self.waiting, self.turn)
        waiting = self.waiting[behind:] + self.waiting[:behind]
        while left and waiting:
            share, more = max(least, left // len(waiting)), []
            for path in waiting:
                if not left:
                    break
                wanted, size, found = min(share, left), self.size[path], 0
                try:
                    at, found = self._skip_records(system, path, self.known[path], size, wanted)
                except FileNotFoundError:
                    self._move(path, None)
                if found:
                    left -= found
                    self.turn = path
                    self._move(path, at)
                if found == wanted and at < size:
                    more.append(path)
                else:
                    # Nothing more is known of it until the next listing.
                    del self.waiting[bisect_left(self.waiting, path)]
            waiting = more
        return left

    def _move(self, path: str, at: int | None) -> None:
        if at is None:
            del self.known[path]
        else:
            self.known[path] = at
        self.since[path] = at

    def _offset(self) -> dict:
        if len(self.since) > max(_LEAST_MOVED, len(self.known) // 16):
            self.packed, self.since = _pack_positions(self.known), {}
            self._keep_table(dict(self.known))
        if not self.packed and not self.since:
            return {}
        return {_TURN: {"files": self.packed, "since": dict(self.since), "turn": self.turn}}

    def _keep_table(self, table: dict[str, int]) -> None:
        # A micro-batch needs the tables of its begin and its end.
        self.tables = dict([*self.tables.items()][-1:])
        self.tables[self.packed] = table

    def _skip_records(self, system, path, at, size, limit) -> tuple[int, int]:
        """End of the next ``limit`` records, or of as many as are whole, and their number."""
        n, found, end, position, rest = len(self.separator), 0, at, at, b""
        with system.open_input_file(path) as file:
            while found < limit and (chunk := file.read_at(min(_CHUNK, size - position), position)):
                base, text = position - len(rest), rest + chunk
                position += len(chunk)
                *records, rest = text.split(self.separator, limit - found)
                if records:
                    found += len(records)
                    end = base + len(text) - len(rest)
                # What is left holds no separator, so only the begin of one matters.
                rest = rest[len(rest) - n + 1:] if 0 < n - 1 < len(rest) else rest if n > 1 else b""
        return end, found

    def _last_record_end(self, system, path, floor, top) -> int:
        """End of the last separator in front of ``top``, searched from behind."""
        n, end = len(self.separator), top
        with system.open_input_file(path) as file:
            while end > floor:
                begin = max(floor, end - _CHUNK)
                found = file.read_at(min(top, end + n - 1) - begin, begin).rfind(self.separator)
                if found >= 0:
                    return begin + found + n
                end = begin
        return floor

    def _first_record_end(self, system, path, at, size, floor) -> int:
        n, begin = len(self.separator), max(floor, at - len(self.separator) + 1)
        with system.open_input_file(path) as file:
            while begin < size:
                found = file.read_at(min(_CHUNK + n, size - begin), begin).find(self.separator)
                if found >= 0:
                    return begin + found + n
                begin += _CHUNK
        return floor

    def _table(self, packed: str) -> dict[str, int]:
        found = self.tables.get(packed)
        return _unpack_positions(packed) if found is None else found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        (from_packed, from_since, _), (packed, since, turn) = _parts_of(start), _parts_of(end)
        before, after = self._table(from_packed), self._table(packed)
        if self.known is None:
            self.known = {path: at for path, at in (after | since).items() if at is not None}
            self.packed, self.since, self.turn = packed, dict(since), turn
            self._keep_table(after)
        paths = from_since.keys() | since.keys()
        if from_packed != packed:
            paths |= before.keys() | after.keys()
        ranges = []
        for path in sorted(paths):
            stop = since.get(path, after.get(path, 0)) or 0
            begin = from_since.get(path, before.get(path, 0)) or 0
            # A shorter file was truncated or replaced: it is read from its beginning.
            begin = begin if begin <= stop else 0
            for at in range(begin, stop, self.range_bytes):
                ranges.append(Range(path, at, min(at + self.range_bytes, stop), at == begin, stop))
        return ranges if self.open_cost is None else self._pack(ranges)

    def _pack(self, ranges: list[Range]) -> list[InputPartition]:
        """Small ranges share tasks."""
        packs, room = [], 0
        for r in ranges:
            cost = max(r.end - r.begin, self.open_cost)
            if cost > room:
                packs.append([])
                room = self.range_bytes
            packs[-1].append(r)
            room -= cost
        return [pack[0] if len(pack) == 1 else Ranges(pack) for pack in packs]

    def read(self, partition: Range | Ranges) -> Iterator[pa.RecordBatch]:
        for one in partition.ranges if isinstance(partition, Ranges) else [partition]:
            yield from self._read(one)

    def _read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _, prefix = _filesystem(self.path)
        sep, n = self.separator, len(self.separator)
        name = prefix + partition.path if prefix else "file:" + partition.path
        with system.open_input_file(partition.path) as file:
            at, rest = partition.begin, b""
            mark = partition.begin == 0 and file.read_at(3, 0) == _BYTE_ORDER_MARK
            if not partition.first:
                # The record that runs into this range belongs to the range before.
                at, rest = self._skip(file, partition)
            record_at, values = at - len(rest), []
            done = record_at >= partition.end
            # A long record is put together once; until then only new bytes are searched.
            parts, unsearched = [rest], rest
            while not done:
                chunk = file.read_at(min(_CHUNK, partition.size - at), at)
                at += len(chunk)
                parts.append(chunk)
                unsearched += chunk
                records = []
                if sep in unsearched:
                    *records, rest = b"".join(parts).split(sep)
                    parts, unsearched = [rest], rest
                unsearched = unsearched[max(0, len(unsearched) - n + 1):]
                for record in records:
                    if record_at >= partition.end:
                        done = True
                        break
                    values.append(record)
                    record_at += len(record) + n
                    if len(values) >= _ROWS:
                        yield self._batch(name, partition, values, mark)
                        values, mark = [], False
                done = done or not chunk or record_at >= partition.end
            if values:
                yield self._batch(name, partition, values, mark)

    def _skip(self, file, partition):
        """First record start at or behind the range's begin, and the bytes read beyond it."""
        n = len(self.separator)
        at = max(0, partition.begin - n)
        text = bytearray()
        while True:
            chunk = file.read_at(min(_CHUNK, partition.size - at - len(text)), at + len(text))
            searched = max(0, len(text) - n + 1)
            text += chunk
            found = text.find(self.separator, searched)
            if found >= 0:
                return at + len(text), bytes(text[found + n:])
            if not chunk:
                return partition.size, b""

    def _batch(self, name, partition, values, mark) -> pa.RecordBatch:
        n, rows = len(self.separator), len(values)
        width = [len(v) + n for v in values]
        if mark:
            values[0] = values[0][len(_BYTE_ORDER_MARK):]
        return pa.record_batch([
            pa.repeat(pa.scalar(name), rows), pa.repeat(pa.scalar(partition.begin, pa.int64()), rows),
            pa.repeat(pa.scalar(partition.size, pa.int64()), rows),
            pa.array(width, pa.int64()),
            pa.array(values, pa.binary()).view(pa.string())], schema=_SCHEMA)


class LogTail(DataSource):
    """``spark.readStream.format("log_tail").option("path", ...)``.

    Options: ``path`` (file or folder), ``separator``, ``rangeBytes`` per task, ``openCostBytes`` (ranges share
    tasks, each counted as that many bytes at least; without it each has its own), and one of
    ``maxBytesPerTrigger`` per file and ``maxRecordsPerTrigger`` of all files. Both hold after a
    restart too. The driver reads the records it counts, so keep their number small, and lists the folder
    anew when the text it knows doesn't fill a trigger, or after 20 times the time of a listing. A query
    with the trigger ``availableNow`` ends after one such batch; the next run goes on from there.
    """

    @classmethod
    def name(cls):
        return "log_tail"

    def schema(self):
        return "source string, block bigint, size bigint, width bigint, value string"

    def streamReader(self, schema):
        return TailReader({k.lower(): v for k, v in self.options.items()})


def tail_units(spark: SparkSession, path: str, separator: str = "\n",
               max_bytes_per_trigger: int | None = None, range_bytes: int = 64 << 20,
               max_records_per_trigger: int | None = None) -> DataFrame:
    """Stream of units appended to the files below ``path``."""
    spark.dataSource.register(LogTail)
    reader = (spark.readStream.format("log_tail").option("path", path)
              .option("separator", separator).option("rangeBytes", range_bytes).option("openCostBytes", 4 << 20))
    if max_bytes_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    if max_records_per_trigger is not None:
        reader = reader.option("maxRecordsPerTrigger", max_records_per_trigger)
    return reader.load()
