"""Reading chosen records of raw files by their bytes.

``write_page_index`` keeps where the records of each source lie: one row per page of record numbers. The
``log_pages`` source reads records through it. Conditions on ``source`` and ``idx`` are taken over: they choose
the folder of the index, the row groups and the pages, and only the bytes of the records asked for are read
from the log files.
"""

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    IsNotNull, LessThan, LessThanOrEqual)

from .files import _open
from .tail import _filesystem

PAGE = 1024
#: Folders of an index. Fixed when it is written, and named in its path.
BUCKETS = 64
_COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")
_SCHEMA = pa.schema([("source", pa.string()), ("idx", pa.int64()), ("offset", pa.int64()),
                     ("length", pa.int64()), ("raw", pa.string())])
_LAST = (1 << 63) - 1


def write_page_index(segments: DataFrame, path: str, page: int = PAGE) -> None:
    """Write where ``segments`` (source, idx, offset, length) lie. A page holds ``page`` record numbers at most, so a source of
    any size is dealt out over tasks; its pages lie in order in one folder."""
    at = F.struct("idx", "offset", "length")
    pages = (segments.groupBy("source", F.expr(f"idx div {page}").alias("page"))
             .agg(F.array_sort(F.collect_list(at)).alias("records")))
    (pages.withColumn("part", F.crc32(F.col("source")) % BUCKETS)
     .repartitionByRange("part", "source", "page").sortWithinPartitions("part", "source", "page")
     .write.option("parquet.block.size", 4 << 20).partitionBy("part").parquet(path))


class IndexFile(InputPartition):
    def __init__(self, path: str | None):
        self.path = path


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.index, self.encoding = options["path"], options.get("encoding", "UTF-8")
        self.page = int(options.get("page", PAGE))
        self.sources: set | None = None
        self.numbers: set | None = None
        self.low, self.high = 0, _LAST

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self._take(f):
                yield f

    def _take(self, f: Filter) -> bool:
        column = f.attribute
        if column not in (("source",), ("idx",)):
            return False
        if isinstance(f, IsNotNull):
            return True
        if isinstance(f, (EqualTo, EqualNullSafe, In)):
            chosen = set(f.value) if isinstance(f, In) else {f.value}
            name = "sources" if column == ("source",) else "numbers"
            known = getattr(self, name)
            setattr(self, name, chosen if known is None else known & chosen)
            return True
        if column == ("idx",):
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                return True
            if isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
                return True
        return False

    def partitions(self) -> list[InputPartition]:
        """One per index file of the folders that the sources may lie in; the driver opens none."""
        system, root, _ = _filesystem(self.index)
        if self.sources is None:
            folders = [root]
        else:
            parts = {zlib.crc32(s.encode()) % BUCKETS for s in self.sources if s is not None}
            folders = [f"{root}/part={p}" for p in sorted(parts)]
        files = []
        for folder in folders:
            found = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
            files += [f.path for f in found if f.path.endswith(".parquet")]
        return [IndexFile(f) for f in sorted(files)] or [IndexFile(None)]

    def _wanted(self, file: pq.ParquetFile) -> list[int]:
        """Row groups whose statistics allow a page that is asked for."""
        wanted = []
        for i in range(file.num_row_groups):
            group = file.metadata.row_group(i)
            stats = {group.column(c).path_in_schema: group.column(c).statistics for c in range(group.num_columns)}
            source, page = stats["source"], stats["page"]
            if source is not None and source.has_min_max and self.sources is not None and not any(
                    s is not None and source.min <= s <= source.max for s in self.sources):
                continue
            low, high = self._range()
            if page is not None and page.has_min_max and (page.max < low // self.page or page.min > high // self.page):
                continue
            wanted.append(i)
        return wanted

    def _range(self) -> tuple[int, int]:
        if not self.numbers:
            return (self.low, self.high) if self.numbers is None else (1, 0)
        return max(self.low, min(self.numbers)), min(self.high, max(self.numbers))

    def read(self, partition: IndexFile) -> Iterator[pa.RecordBatch]:
        low, high = self._range()
        if partition.path is None or low > high:
            return
        system, _, _ = _filesystem(self.index)
        with system.open_input_file(partition.path) as index:
            file = pq.ParquetFile(index)
            for group in self._wanted(file):
                pages = file.read_row_group(group, ["source", "page", "records"])
                keep = pc.and_(pc.greater_equal(pages["page"], low // self.page), pc.less_equal(pages["page"], high // self.page))
                if self.sources is not None:
                    keep = pc.and_(keep, pc.is_in(pages["source"], pa.array([s for s in self.sources if s is not None], pa.string())))
                if self.numbers is not None:
                    keep = pc.and_(keep, pc.is_in(pages["page"], pa.array([n // self.page for n in self.numbers], pa.int64())))
                chosen = pages.filter(keep)
                for i in range(chosen.num_rows):
                    batch = self._page(chosen["source"][i].as_py(), chosen["records"][i].values, low, high)
                    if batch.num_rows:
                        yield batch

    def _page(self, source: str, records: pa.StructArray, low: int, high: int) -> pa.RecordBatch:
        idx, offset, length = (records.field(n) for n in ("idx", "offset", "length"))
        keep = pc.and_(pc.greater_equal(idx, low), pc.less_equal(idx, high))
        if self.numbers is not None:
            keep = pc.and_(keep, pc.is_in(idx, pa.array(list(self.numbers), pa.int64())))
        idx, offset, length = (x.filter(keep) for x in (idx, offset, length))
        texts = []
        if len(idx):
            begin = pc.min(offset).as_py()
            data = read_bytes(source, begin, pc.max(pc.add(offset, length)).as_py())
            for o, n in zip(offset.to_pylist(), length.to_pylist()):
                text = data[o - begin:o - begin + n].decode(self.encoding, "replace").removesuffix("\n")
                texts.append(text.removesuffix("\r"))
        return pa.record_batch([pa.repeat(pa.scalar(source), len(idx)), idx.cast(pa.int64()), offset.cast(pa.int64()),
                                length.cast(pa.int64()), pa.array(texts, pa.string())], schema=_SCHEMA)


def read_bytes(source: str, begin: int, end: int) -> bytes:
    """Bytes of a log file; of a compressed one those of its text, read from its begin."""
    system, name = _open(source)
    if name.endswith(_COMPRESSED):
        with system.open_input_stream(name) as stream:
            left = begin
            while left and (chunk := stream.read(min(left, 1 << 20))):
                left -= len(chunk)
            data = stream.read(end - begin)
    else:
        with system.open_input_file(name) as file:
            data = file.read_at(end - begin, begin)
    # The last line of a file may have no break.
    if len(data) < end - begin - 1:
        raise ValueError(f"{source} is shorter than its index says; write the index again")
    return data


class LogPages(DataSource):
    """``spark.read.format("log_pages").load(index)``: ``source, idx, offset, length, raw``.

    Options: ``encoding`` of the files, ``page`` as given to ``write_page_index``.
    """

    @classmethod
    def name(cls):
        return "log_pages"

    def schema(self):
        return "source string, idx bigint, offset bigint, length bigint, raw string"

    def reader(self, schema):
        return PageReader({k.lower(): v for k, v in self.options.items()})


def read_pages(spark: SparkSession, index: str, encoding: str = "UTF-8", page: int = PAGE) -> DataFrame:
    """Segments of all files of an index; conditions on ``source`` and ``idx`` choose what is read."""
    spark.dataSource.register(LogPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("log_pages").option("encoding", encoding).option("page", page).load(index)
