"""Records taken apart by a user's own code, where rules can't say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.levels import parse_level
from ..functions.times import parse_timestamp
from .common import apply_malformed_policy, to_records
from .rules import SLOTS

Scan = Callable[[str], dict[str, str | None]]


def _scanner(make: Callable[[], Scan]):
    """A table function that keeps all columns of its table and adds what a scan of ``raw`` finds."""
    class Scanner:
        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            columns = table.dataType
            if "raw" not in columns.names:
                raise ValueError("a table to scan has the records in a column raw")
            clash = [c for c in columns.names if c in (*SLOTS, "malformed")]
            if clash:
                raise ValueError(f"columns {clash} would be hidden by what the scan finds")
            found = [T.StructField(name, T.StringType()) for name in (*SLOTS, "malformed")]
            return AnalyzeResult(schema=T.StructType([*columns.fields, *found]))

        def __init__(self):
            self.scan = make()

        def eval(self, row):
            slots, malformed = {}, None
            if row["raw"] is not None:
                try:
                    slots = self.scan(row["raw"])
                except ValueError as error:
                    malformed = str(error) or "not scanned"
            yield (*row, *[slots.get(name) or None for name in SLOTS], malformed)

    return F.udtf(Scanner)


def scan_records(segments: DataFrame, make: Callable[[], Scan], timestamp_format: str | None = None,
                 on_malformed: str = "drop") -> DataFrame:
    """Records from ``segments`` by code: ``make`` is called once per task and gives a function from the text of a record
    to its slots (``rules.SLOTS``, each a text; empty and missing ones are null). What it keeps between calls, such as
    compiled patterns or a cache, lives as long as the task. A ``ValueError`` makes a record malformed; any other error
    ends the query. A null text has no slots.

    The code sees one record after the other and goes through Python row by row; rules stay in the JVM.
    """
    scanned = _scanner(make)(segments.asTable())
    patterns = (timestamp_format,) if timestamp_format else ()
    return apply_malformed_policy(to_records(scanned.withColumns({
        "timestamp": parse_timestamp(F.col("timestamp"), *patterns), "level": parse_level(F.col("level"))})), on_malformed)
