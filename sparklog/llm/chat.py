"""Chat formatting by columnar byte assembly.

A turn becomes ``<turn>role newline text </turn> newline``. In roles and texts a backslash becomes two and one is put
before every ``<turn`` and ``</turn``, so that an unescaped mark is always the template's own and
the original comes back. A line break in a role is escaped as backslash and ``n``.

Rows are shuffled by conversation and sorted by turn. A task takes Arrow batches; for each it has the
lengths of all segments (mark, role, break, text, end mark), their running sums as places in the output,
and scatters headers and contents into one preallocated buffer. A conversation that crosses batches is
carried over as finished bytes.

The loss mask is a list of byte ranges of the output: the assistants' texts, escaped as they stand there.

Defined results: null roles and texts are empty; rows of a null conversation are one conversation;
equal turns are ordered by role and text, a null turn first; repeated rows are turns of their own;
other columns are not read; an empty table gives an empty one. A conversation is one value of the
result, so it must fit into one: 2 GB.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: The template. Fixed values.
OPEN, BREAK, CLOSE = b"<turn>", b"\n", b"</turn>\n"
ASSISTANT = "assistant"
SCHEMA = "conv_id long, n_turns long, formatted string, loss_start array<long>, loss_end array<long>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
                    ("loss_start", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64()))])


def escape(texts: pa.Array, role: bool = False) -> pa.Array:
    out = pc.replace_substring(texts, "\\", "\\\\")
    out = pc.replace_substring_regex(out, "(</?turn)", r"\\\1")
    return pc.replace_substring(out, "\n", "\\n") if role else out


def unescape(text: str, role: bool = False) -> str:
    if "\\" not in text:
        return text
    return re.sub(r"\\(.)", lambda m: "\n" if role and m[1] == "n" else m[1], text, flags=re.S)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, data


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
    """Copy ``length[i]`` bytes from ``begin[i]`` of ``data`` to ``at[i]`` of ``out``: short ones all at
    once, so many that their indices take little memory, long ones as they are."""
    for i in np.flatnonzero(length > _LONG):
        out[at[i]:at[i] + length[i]] = data[begin[i]:begin[i] + length[i]]
    short = length <= _LONG
    at, begin, length = at[short], begin[short], length[short]
    group = np.cumsum(length) // (256 * _LONG)
    for first, last in zip(np.flatnonzero(np.diff(group, prepend=-1)), np.append(np.flatnonzero(np.diff(group)) + 1, len(group))):
        _scatter_short(out, at[first:last], data, begin[first:last], length[first:last])


def _scatter_short(out: np.ndarray, at: np.ndarray, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
    total = int(length.sum())
    if total:
        within = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(at, length) + within] = data[np.repeat(begin, length) + within]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted turns one after another: the buffer, where each turn begins (with the end), and where
    its text begins and ends."""
    n = len(roles)
    role_at, role_data = _bytes_of(escape(roles, role=True))
    text_at, text_data = _bytes_of(escape(texts))
    role_len, text_len = np.diff(role_at), np.diff(text_at)
    turn_len = len(OPEN) + role_len + len(BREAK) + text_len + len(CLOSE)
    turn_at = np.concatenate([[0], np.cumsum(turn_len)])
    out = np.empty(int(turn_at[-1]), np.uint8)
    begin = turn_at[:-1]
    for mark, at in ((OPEN, begin), (BREAK, begin + len(OPEN) + role_len), (CLOSE, turn_at[1:] - len(CLOSE))):
        out[(at[:, None] + np.arange(len(mark))).ravel()] = np.tile(np.frombuffer(mark, np.uint8), n)
    text_from = begin + len(OPEN) + role_len + len(BREAK)
    _scatter(out, begin + len(OPEN), role_data, role_at[:-1], role_len)
    _scatter(out, text_from, text_data, text_at[:-1], text_len)
    return out, turn_at, text_from, text_from + text_len


class _Open:
    """The conversation that the next batch may go on with."""

    def __init__(self, conv_id):
        self.conv_id, self.parts, self.size, self.turns, self.start, self.end = conv_id, [], 0, 0, [], []

    def add(self, data: np.ndarray, turns: int, start: np.ndarray, end: np.ndarray) -> None:
        self.parts.append(data)
        self.start.append(start + self.size)
        self.end.append(end + self.size)
        self.size += len(data)
        self.turns += turns


def _result(done: list[_Open]) -> pa.RecordBatch:
    def lists(of):
        values = [np.concatenate(of(c)) for c in done]
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, np.concatenate(values).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum([c.size for c in done])]).astype(np.int32)
    data = np.concatenate([p for c in done for p in c.parts])
    texts = pa.StringArray.from_buffers(len(done), pa.py_buffer(offsets), pa.py_buffer(data))
    return pa.RecordBatch.from_arrays([
        pa.array([c.conv_id for c in done], pa.int64()), pa.array([c.turns for c in done], pa.int64()), texts,
        lists(lambda c: c.start), lists(lambda c: c.end)], schema=_ARROW)


_BATCH_BYTES = 1 << 24
_LONG = 1 << 13


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, done, size = None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, known = batch.column(0), np.asarray(batch.column(0).is_valid())
        values = pc.fill_null(ids, 0).to_numpy()
        roles, texts = pc.fill_null(batch.column(1), ""), pc.fill_null(batch.column(2), "")
        data, turn_at, text_from, text_to = assemble(roles, texts)
        loss = np.asarray(pc.equal(roles, ASSISTANT))
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (known[1:] != known[:-1])])
        first = np.flatnonzero(new)
        for begin, end in zip(first, np.append(first[1:], batch.num_rows)):
            conv_id = int(values[begin]) if known[begin] else None
            if current is None or current.conv_id != conv_id:
                if current is not None:
                    done.append(current)
                    size += current.size
                current = _Open(conv_id)
            base, on = turn_at[begin], np.flatnonzero(loss[begin:end]) + begin
            current.add(data[base:turn_at[end]], end - begin, text_from[on] - base, text_to[on] - base)
            if size >= _BATCH_BYTES:
                yield _result(done)
                done, size = [], 0
    if current is not None:
        yield _result([*done, current])


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text): its formatted text and the byte
    ranges under the loss mask."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn",
                        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "text").mapInArrow(_format, SCHEMA))




def parse(formatted: bytes) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, as they were."""
    out, at = [], 0
    while at < len(formatted):
        role_end = formatted.index(b"\n", at)
        close = at
        while True:
            # The template's own end mark has no escape before it: an even number of backslashes.
            close = formatted.index(CLOSE, close)
            head = formatted[role_end + 1:close]
            if (len(head) - len(head.rstrip(b"\\"))) % 2 == 0:
                break
            close += 1
        role = formatted[at + len(OPEN):role_end].decode("utf-8", "surrogatepass")
        out.append((unescape(role, role=True), unescape(head.decode("utf-8", "surrogatepass"))))
        at = close + len(CLOSE)
    return out
