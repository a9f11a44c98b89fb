"""Sum-of-squares online packing of documents into sequences of a fixed length.

Documents are token ids and one end id. What is longer than a sequence is cut into full ones and a
rest. Rests are placed one by one: of the fill levels that can take a rest, the one is chosen that
makes the sum of squared counts of partially filled sequences smallest, an empty sequence being
level 0. The counts are kept in an array by level, so a placement is one vector expression, and the open
sequences of a level in a stack. At the end the emptiest open sequences are cut up to fill the
others, so a task leaves less than one sequence unfilled; that one is cut at powers of two if
asked for, where sequences need no padding.

Every task packs the rows that it scans; nothing is shuffled, and no task needs another one.
A task holds the open sequences of its rows only: pieces are ids, not tokens.

Tokenizers are read from a file by name (see ``Tokens``).

Defined results: a null text is empty, and an empty text is its end id alone; repeated rows are packed
each for itself; other columns are not read; ids of sequences are unique, not consecutive; an empty
table gives an empty one.
"""

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, ids binary")
END = 0


#: How byte-level tokenizers of this kind cut a text before they merge bytes. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in such a vocabulary: itself where it can be printed, else
    the next one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Ids of texts as little-endian 32-bit numbers, as the tokenizer of a file gives them.

    A text is cut by the pattern and merged by the tokenizer's ranks in one call; a text with a special token
    goes to the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte_of = _byte_of()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        for t in self.special:
            vocab.pop(t, None)
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
        self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> bytes:
        if any(t in text for t in self.special):
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        else:
            ids = self.ranks.encode_to_numpy(text, disallowed_special=())
        return ids.astype("<u4").tobytes()


class Packer:
    """Open sequences by fill level; closed ones are handed to ``emit(pieces)``."""

    def __init__(self, size: int, emit: Callable[[list], None]):
        self.size, self.emit = size, emit
        self.counts = np.zeros(size + 1, np.int64)
        self.open: list[list] = [[] for _ in range(size + 1)]

    def place(self, piece, length: int) -> None:
        """Put a piece of 1 to ``size`` tokens where the sum of squared counts grows least."""
        counts, size = self.counts, self.size
        # Leaving level h takes 2 n[h] - 1 from the sum, reaching h + length adds 2 n[h + length] + 1;
        # level 0 and a full sequence count nothing. Of equal levels the fullest is chosen.
        levels = np.arange(size - length, -1, -1)
        change = 2 * counts[levels + length] + 1
        change[0] = 0
        leave = 2 * counts[levels] - 1
        leave[-1] = 0
        change = np.where((counts[levels] > 0) | (levels == 0), change - leave, np.iinfo(np.int64).max)
        level = int(levels[np.argmin(change)])
        pieces = self.open[level].pop() if level else []
        counts[level] -= level > 0
        pieces.append((piece, length))
        self._keep(pieces, level + length)

    def _keep(self, pieces: list, level: int) -> None:
        if level == self.size:
            self.emit(pieces)
        elif level:
            self.open[level].append(pieces)
            self.counts[level] += 1

    def close(self, cut: Callable, powers_of_two: bool = False) -> None:
        """Cut up the emptiest sequences to fill the fullest. ``cut(piece, n)`` gives the first n tokens of a
        piece and the rest."""
        left = [(level, pieces) for level in range(1, self.size) for pieces in self.open[level]]
        low, high = 0, len(left) - 1
        spare = []
        while low <= high:
            level, pieces = left[high]
            while level < self.size and (spare or low < high):
                if not spare:
                    spare = left[low][1]
                    low += 1
                piece, length = spare.pop()
                fits = min(length, self.size - level)
                if fits < length:
                    piece, rest = cut(piece, fits)
                    spare.append((rest, length - fits))
                pieces.append((piece, fits))
                level += fits
            if powers_of_two and level < self.size:
                for part in _powers(pieces, level, cut):
                    self.emit(part)
            else:
                self.emit(pieces)
            high -= 1
        if spare:
            level = sum(n for _, n in spare)
            for part in _powers(spare, level, cut) if powers_of_two else [spare]:
                self.emit(part)


def _powers(pieces: list, level: int, cut: Callable) -> list[list]:
    out, stack = [], pieces[::-1]
    while level:
        room, part = 1 << (level.bit_length() - 1), []
        level -= room
        while room:
            piece, length = stack.pop()
            if length > room:
                piece, rest = cut(piece, room)
                stack.append((rest, length - room))
                length = room
            part.append((piece, length))
            room -= length
        out.append(part)
    return out


def _cut(piece, n):
    doc_id, start, ids, total = piece
    return (doc_id, start, ids[:4 * n], total), (doc_id, start + n, ids[4 * n:], total)


def _pack(path: str, size: int, with_ids: bool, powers_of_two: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path)
        done: list[list] = []
        packer = Packer(size, done.append)
        sequence = TaskContext.get().partitionId() << 33

        def results():
            nonlocal sequence
            rows = []
            for pieces in done:
                offset = 0
                for (doc_id, start, ids, total), length in pieces:
                    rows.append((doc_id, start, length, zlib.crc32(ids), total, sequence, offset, ids if with_ids else None))
                    offset += length
                sequence += 1
            done.clear()
            columns = list(zip(*rows)) or [()] * 8
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:7]], pa.array(columns[7], pa.binary())],
                                              [f.split(" ")[0] for f in SCHEMA.split(", ")])

        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokens.of(text.as_py() or "") + end
                total = len(ids) // 4
                full = total // size * size
                for start in range(0, full, size):
                    done.append([((doc_id, start, ids[4 * start:4 * (start + size)], total), size)])
                if full < total:
                    packer.place((doc_id, full, ids[4 * full:], total), total - full)
                if len(done) >= 4096:
                    yield results()
        packer.close(_cut, powers_of_two)
        yield results()
    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, with_ids: bool = True, powers_of_two: bool = True) -> DataFrame:
    """Pieces of the documents (doc_id, text) and their places in sequences of ``size`` tokens.

    ``tokenizer`` is the path of a tokenizer file that every node has. Each piece has its ids (binary,
    little-endian 32 bits) if ``with_ids``, and their CRC.
    """
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _pack(tokenizer, size, with_ids, powers_of_two), SCHEMA)
    return packed if with_ids else packed.drop("ids")
