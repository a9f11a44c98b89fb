"""Records of payload streams: over several payloads, of formats found on the way.

Each origin (a sender, a topic partition) is one text, its payloads in order. Keyed state holds what the
text needs to go on: the format that its first characters showed, the header line of delimited
text, and the bytes of the record that is still open. ``frame_payloads`` turns payloads into chunks of
complete records; cutting records out of a chunk and parsing them is left to ``chunk_records``, in parallel
and without Python, so that one busy origin costs its task a search for the last record end only.

A timer gives out what stays open, since the last record of a quiet origin may miss its end.
"""

import codecs
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import scratch
from ..formats import csv
from ..formats.log4j import EVENT_END, EVENT_START
from ..formats.registry import get_format
from ..formats.rules import RuleSet
from ..sources.files import DETECTION_CHARS

#: Formats that framing knows.
FORMATS = ("csv", "log4j", "plain", "rules")
_CHUNK_BYTES = 4 << 20
_STATE = "format string, header string, rest binary, chunks long"
_MARK = "﻿"


# --------------------------------------------------------------- ends of records

def _csv_end(text: str, quote: str = '"') -> int:
    """Characters up to the last line break outside of quotes."""
    parts = text.split(quote)
    at = len(text)
    for i in range(len(parts) - 1, -1, -1):
        at -= len(parts[i])
        found = parts[i].rfind("\n") if i % 2 == 0 else -1
        if found >= 0:
            return at + found + 1
        at -= len(quote)
    return 0


def _rules_end(text: str, start: re.Pattern, end: re.Pattern | None) -> int:
    """Characters up to the record that is still open, which begins at the last start."""
    last = None
    for last in start.finditer(text):
        pass
    if last is None:
        # Text that may yet be the begin of a start: its last line.
        return text.rfind("\n") + 1
    closed = end.search(text, last.end()) if end else None
    return closed.end() if closed else last.start()


def _closed_by(format: str, options: dict) -> Callable[[str], int]:
    """How many characters of a text are complete records of the format."""
    if format == "csv":
        return lambda text: _csv_end(text, options.get("quote", '"'))
    if format == "log4j":
        return lambda text: max(0, text.rfind(EVENT_END) + len(EVENT_END)) if EVENT_END in text else 0
    if format == "plain":
        return lambda text: text.rfind("\n") + 1
    rules: RuleSet = options["rules"]
    if rules.start_lines > 1:
        raise ValueError("a payload may end inside of a start; starts have to lie in one line")
    start = re.compile(rules.expand(rules.start), re.MULTILINE)
    end = re.compile(rules.expand(rules.end)) if rules.end else None
    return lambda text: _rules_end(text, start, end)


def sniff(text: str, final: bool) -> str | None:
    """Format of a text that begins with ``text``, like the detection for files; null while it may still
    show. ``final`` says that nothing is waited for."""
    head = text[:DETECTION_CHARS].lstrip(_MARK)
    lines = [x.rstrip("\r") for x in head.split("\n")]
    whole = final or len(text) >= DETECTION_CHARS
    first = next((x for x in (lines if whole else lines[:-1]) if x), None)
    if first is not None and {"level", "message"} & set(re.split(r"[;,|]", first.lower())):
        return "csv"
    if EVENT_START.rstrip() in head:
        return "log4j"
    # An event's tag may be cut at the end of what there is.
    tag = EVENT_START.rstrip()
    if not whole and (first is None or any(head.endswith(tag[:n]) for n in range(1, len(tag)))):
        return None
    return "plain"


class _Origin:
    """The text of one origin while a micro-batch of it is read."""

    def __init__(self, state: tuple | None, format: str, options: dict, encoding: str):
        self.format, self.header, self.rest, self.chunks = state or (None, None, b"", 0)
        self.rest = bytes(self.rest or b"")
        if format != "auto":
            self.format = format
        self.options, self.encoding = options, encoding
        self.rows = []

    def state(self) -> tuple:
        return self.format, self.header, self.rest, self.chunks

    def add(self, data: bytes, final: bool = False) -> None:
        """Go on with ``data``; complete records become a chunk, with ``final`` all that there is."""
        data = self.rest + data
        decoder = codecs.getincrementaldecoder(self.encoding)("surrogateescape")
        text = decoder.decode(data, final)
        if self.format is None:
            self.format = sniff(text, final)
        options = self.options.get(self.format, {})
        end = len(text) if final else _closed_by(self.format, options)(text) if self.format else 0
        done = text[:end]
        self.rest = b"" if final else data[len(done.encode(self.encoding, "surrogateescape")):]
        if self.chunks == 0:
            done = done.removeprefix(_MARK)
        if self.format == "csv" and "layout" not in options and self.header is None and done.strip("\r\n"):
            done = done.lstrip("\r\n")
            self.header, done = _first_record(done, options.get("quote", '"'))
        if done:
            clean = done.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
            self.rows.append((self.format, self.header, self.chunks, clean))
            self.chunks += 1


def _first_record(text: str, quote: str) -> tuple[str, str]:
    at = text.find("\n") + 1
    while at and text.count(quote, 0, at) % 2:
        at = text.find("\n", at) + 1
    at = at or len(text)
    return text[:at].rstrip("\r\n"), text[at:]


def frame_payloads(payloads: DataFrame, key: list[str], order: list[str], format: str = "auto",
                   options: dict[str, dict] | None = None, value: str = "value", between: str = "\n",
                   encoding: str = "UTF-8", flush_after_ms: int | None = None) -> DataFrame:
    """Stream of chunks ``key..., format, header, chunk, text`` from a stream of binary payloads.

    ``key`` names an origin, ``order`` the columns that put its payloads of one micro-batch in order. ``between``
    stands between two payloads of an origin: by default each payload ends a line; with ``""`` a record
    may be cut at any byte. ``format="auto"`` finds each origin's format. ``options`` holds arguments per
    format: ``layout``, ``delimiter`` and ``quote`` for csv, ``rules`` for rules, whose patterns must mean
    the same in Python.

    Payloads that are null or empty are left out. With ``flush_after_ms`` a record still open after
    that time without payloads is given out as it is, and the next payload begins a new one. Such a stream always has a next
    micro-batch, so it is for running queries; a run over what there is (``availableNow``) goes without.
    """
    options = options or {}
    if format != "auto":
        if format not in FORMATS:
            raise ValueError(f"framing knows {FORMATS}")
        _closed_by(format, options.get(format, {}))
    separator = between.encode(encoding)

    def run(group, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        origin = _Origin(state.getOption, format, options, encoding)
        if state.hasTimedOut:
            if origin.rest:
                origin.add(b"", final=True)
        else:
            rows = pd.concat(list(frames)).sort_values(order, kind="stable")[value]
            waiting, size = [], 0
            for payload in rows:
                waiting += [bytes(payload), separator]
                size += len(payload)
                if size >= _CHUNK_BYTES:
                    origin.add(b"".join(waiting))
                    waiting, size = [], 0
            if waiting:
                origin.add(b"".join(waiting))
        state.update(origin.state())
        if flush_after_ms is not None and origin.rest:
            state.setTimeoutDuration(flush_after_ms)
        if origin.rows:
            yield pd.DataFrame([(*group, *row) for row in origin.rows], columns=names)

    fields = [payloads.schema[k] for k in key]
    schema = T.StructType([*fields, *T.StructType.fromDDL("format string, header string, chunk long, text string").fields])
    names = schema.names
    rows = payloads.where(F.octet_length(value) > 0).select(*key, *order, F.col(value).cast("binary").alias(value))
    return rows.groupBy(*key).applyInPandasWithState(
        run, schema, _STATE, "append",
        GroupStateTimeout.NoTimeout if flush_after_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


# ---------------------------------------------------------------- chunks to records

def chunk_records(chunks: DataFrame, options: dict[str, dict] | None = None) -> DataFrame:
    """Records of a table of chunks. ``origin`` has the key, the chunk and the place in it."""
    options = options or {}
    key = [c for c in chunks.columns if c not in ("format", "header", "text")]
    # Chunks have a bounded size, so this deals out a busy origin's text evenly.
    chunks = chunks.repartition(*key)
    return reduce(DataFrame.unionByName, [_records(chunks, name, key, dict(options.get(name, {})))
                                          for name in FORMATS if name != "rules" or "rules" in options])


def _records(chunks: DataFrame, name: str, key: list[str], options: dict) -> DataFrame:
    fmt = get_format(name)
    rows = chunks.where(F.col("format") == name)
    if name == "csv":
        layout, delimiter, quote = options.pop("layout", None), options.get("delimiter"), options.get("quote", '"')
        if layout is None:
            rows = csv.header_layout(rows, delimiter, quote)
        options["layout"] = layout
    texts = fmt.payload(F.col("text"), options["rules"]) if fmt.payload_args else fmt.payload(F.col("text"))
    carried = [c for c in rows.columns if c not in (*key, "format", "header", "text")]
    rows = rows.select(*key, *carried, F.posexplode(texts).alias("pos", "raw"))
    rows = rows.select(F.struct(*key, "pos").alias("origin"), *carried, "raw")
    return fmt.parse(rows, **options).drop("source", "idx", "offset", "length")


def write_payload_records(chunks: DataFrame, out: str, options: dict[str, dict] | None = None) -> DataStreamWriter:
    """Stream writer of ``chunk_records`` below ``out/records``; a repeated micro-batch writes the same rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            with scratch.passing():
                chunk_records(rows, options).write.mode("overwrite").parquet(f"{out}/records/batch_id={batch_id}")
        finally:
            rows.unpersist()
    return chunks.writeStream.foreachBatch(write)
