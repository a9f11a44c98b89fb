"""Vector codes: a codebook for each of equally long parts, fitted by Lloyd rounds that skip idle entries.

Every component becomes an integer, and each part position has a codebook of integer entries. Rounds
assign every part to its nearest entry and move each entry to the floored mean of its parts. The
state between rounds, a written table of codes and exact squared distances, spares work: a part
whose entry did not move compares itself with moved entries only, against its stored distance;
parts of moved entries scan the whole codebook. Ties go to the lower index in both cases.

Tasks add up their own parts, and one row per entry and task is shuffled. The driver holds the
codebooks only: ``entries`` vectors. All rows learn; nothing is sampled.

Numbers are exact: distances are taken in doubles while the largest component proves that they stay
below 2^53, else in Python integers. A component beyond +-2^50 counts as +-2^50.

Defined results: null vectors and those with null or non-finite components are left out; repeated
rows count each; a null id comes last in order, equal ids go by their vectors; with fewer vectors
than entries the codebook has so many entries. The vector of the smallest id whose length is a
multiple of ``parts`` gives the length; vectors of another length have a null code and error.
An error or a sum beyond a long is null. Other columns are not read; an empty table gives an empty one.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .. import scratch

_FARTHEST = 2.0 ** 50
_LONG = (1 << 63) - 1
_SALTS = 32


def finite(vector: Column) -> Column:
    """True for a vector without null, NaN and infinite components; false for null."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def whole_numbers(flat: np.ndarray, scale: int, exact: bool) -> np.ndarray:
    """floor(scale * x): doubles that hold it, or Python integers if ``exact`` is asked for."""
    limit = scale * _FARTHEST
    floors = np.clip(np.floor(flat.astype(np.float64) * scale), -limit, limit)
    return np.array([int(x) for x in floors], dtype=object) if exact else floors


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x.dot(book.T) + (book * book).sum(axis=1)[None, :]


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = _distances(x, book)
    code = d.argmin(axis=1)
    return code, d[np.arange(len(x)), code]


def reassign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, dist: np.ndarray) -> None:
    """Bring ``code`` and ``dist`` of the parts ``x`` up to date, in place, after the entries ``moved``."""
    idle = ~moved[code]
    rescan = np.flatnonzero(~idle)
    if len(rescan):
        code[rescan], dist[rescan] = _nearest(x[rescan], book)
    active, stay = np.flatnonzero(moved), np.flatnonzero(idle)
    if len(active) and len(stay):
        at, near = _nearest(x[stay], book[active])
        at = active[at]
        better = (near < dist[stay]) | ((near == dist[stay]) & (at < code[stay]))
        code[stay[better]], dist[stay[better]] = at[better], near[better]


class Codebooks:
    """Entries by part: ``books[part]`` is an array of entries, in doubles or Python integers."""

    def __init__(self, books: np.ndarray, scale: int, exact: bool):
        self.books, self.scale, self.exact = books, scale, exact
        self.parts, self.entries, self.width = books.shape

    def vectors(self, column: pa.Array) -> np.ndarray:
        """(part, row, component) of a batch's vectors."""
        flat = whole_numbers(column.flatten().to_numpy(zero_copy_only=False), self.scale, self.exact)
        return flat.reshape(len(column), self.parts, self.width).transpose(1, 0, 2)

    def numbers(self) -> list[int]:
        return [int(x) for x in self.books.ravel()]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.numbers())).encode()).hexdigest()


def _number(exact: bool) -> str:
    return "decimal(38,0)" if exact else "long"


def _assigned(books: Codebooks, moved: np.ndarray | None):
    """Batches (vec_id, label, embedding[, code, dist]) with code and dist for ``books``."""
    kind = pa.decimal128(38, 0) if books.exact else pa.int64()

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = books.vectors(batch.column(2))
            if moved is None:
                codes, dists = map(np.stack, zip(*[_nearest(x[p], books.books[p]) for p in range(books.parts)]))
            else:
                codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(n, -1).T.astype(np.int64)
                dists = np.array(batch.column(4).flatten().to_pylist(), object) if books.exact else batch.column(4).flatten().to_numpy().astype(np.float64)
                if books.exact:
                    dists = np.array([int(d) for d in dists], object)
                dists = dists.reshape(n, -1).T.copy()
                for p in range(books.parts):
                    reassign(x[p], books.books[p], moved[p], codes[p], dists[p])
            flat = dists.T.ravel()
            flat = pa.array(flat.tolist() if books.exact else flat.astype(np.int64), kind)
            rows = [bytes(r) for r in codes.T.astype(np.uint16)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(rows, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * books.parts, pa.int32()), flat)],
                ["vec_id", "label", "embedding", "code", "dist"])
    return run


def _summed(books: Codebooks):
    """One row per part and entry: how many parts it has in this task, and their sum."""
    def run(batches):
        slots = books.parts * books.entries
        counts = np.zeros(slots, np.int64)
        sums = np.zeros((slots, books.width), object if books.exact else np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1).T
            slot = (codes + np.arange(books.parts)[:, None] * books.entries).ravel()
            x = books.vectors(batch.column(0)).reshape(-1, books.width)
            counts += np.bincount(slot, minlength=slots)
            np.add.at(sums, slot, x if books.exact else x.astype(np.int64))
        used = np.flatnonzero(counts)
        kind = pa.decimal128(38, 0) if books.exact else pa.int64()
        flat = pa.array(sums[used].ravel().tolist(), kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(counts[used], pa.int64()),
             pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * books.width, pa.int32()), flat)], ["slot", "n", "s"])
    return run


def _moved_to_means(books: Codebooks, state: DataFrame) -> tuple[Codebooks, np.ndarray]:
    """The codebooks after an update, and which entries differ from before."""
    number = _number(books.exact)
    rows = (state.select("embedding", "code").mapInArrow(_summed(books), f"slot long, n long, s array<{number}>")
            .groupBy("slot").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(books.width)]).alias("s"))
            .collect())  # at most one row per entry
    new = books.books.copy()
    for row in rows:
        new[divmod(row["slot"], books.entries)] = [int(x) // row["n"] for x in row["s"]]
    return Codebooks(new, books.scale, books.exact), (new != books.books).any(axis=2)


def _first_books(rows: list, parts: int, scale: int, exact: bool) -> Codebooks:
    flat = np.array([x for r in rows for x in r], np.float64)
    whole = whole_numbers(flat, scale, exact).reshape(len(rows), parts, -1)
    return Codebooks(np.ascontiguousarray(whole.transpose(1, 0, 2)), scale, exact)


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, Codebooks | None]:
    """Codes of ``vectors`` (vec_id, embedding, label) and the codebooks, null if nothing can be coded.

    The codes have ``vec_id``, ``label``, ``code`` (a little-endian 16-bit index per part) and ``dist`` (squared
    distance per part), both null for vectors of another length.
    """
    if not 0 < entries <= 65_536:
        raise ValueError("entries must be between 1 and 65,536")
    kept = vectors.select("vec_id", "label", "embedding").where(finite(F.col("embedding")))
    usable = (F.size("embedding") > 0) & (F.size("embedding") % parts == 0)
    rank = F.struct(F.col("vec_id").isNull(), "vec_id", "embedding")
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    lengths = kept.groupBy(F.size("embedding").alias("length")).agg(
        F.min(F.when(usable, F.struct(rank, F.size("embedding")))).alias("first"), F.max(largest).alias("largest"))
    least = lengths.agg(F.min("first").alias("f"), F.count(F.lit(1)).alias("n"), F.max("largest").alias("m")).first()
    if least["f"] is None:
        none = kept.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("array<bigint>").alias("dist"))
        return none, None
    length = least["f"][1]
    bound = min(float(least["m"]), _FARTHEST) * scale + 1
    exact = 4 * (length // parts) * bound * bound >= 2.0 ** 52
    same = kept.where(F.size("embedding") == length)
    start = same.orderBy(F.col("vec_id").isNull(), "vec_id", "embedding").limit(entries).collect()
    books = _first_books([r["embedding"] for r in start], parts, scale, exact)
    schema = f"vec_id {dict(kept.dtypes)['vec_id']}, label {dict(kept.dtypes)['label']}, embedding {dict(kept.dtypes)['embedding']}, code binary, dist array<{_number(exact)}>"
    state = scratch.write_table(same.mapInArrow(_assigned(books, None), schema), "codes")
    for _ in range(rounds):
        books, moved = _moved_to_means(books, state)
        before, state = state, scratch.write_table(state.mapInArrow(_assigned(books, moved), schema), "codes")
        scratch.drop_table(before)
    codes = state.select("vec_id", "label", "code", "dist")
    if least["n"] > 1:
        codes = codes.unionByName(kept.where(F.size("embedding") != length).select(
            "vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast(f"array<{_number(exact)}>").alias("dist")))
    return codes, books


def with_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``error``, the sum of ``dist``, and ``label_error``, its sum over equal labels.

    Labels are added up before they meet their rows; labels that are few are broadcast after a count,
    and beyond that rows meet them by label and a salt, so one label may own any share.
    """
    zero = F.lit(0).cast("decimal(38,0)")
    total = F.aggregate("dist", zero, lambda a, x: (a + x).cast("decimal(38,0)"))
    as_long = lambda d: F.when(d <= _LONG, d.cast("long"))
    rows = codes.withColumn("error", as_long(total))
    sums = scratch.write_table(rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s")), "label-errors").select(
        F.col("label").alias("_label"), as_long(F.col("s")).alias("label_error"))
    on = F.col("label").eqNullSafe(F.col("_label"))
    if sums.count() <= scratch.MAX_BROADCAST_ROWS:
        return rows.join(F.broadcast(sums), on, "left").drop("_label")
    salted = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return (rows.withColumn("_own", F.pmod(F.xxhash64("vec_id", "code"), F.lit(_SALTS)).cast("int"))
            .join(salted, on & (F.col("_own") == F.col("_salt")), "left").drop("_label", "_own", "_salt"))


def as_hex(code: Column, parts: int) -> Column:
    """Two hex digits per index; for codebooks of at most 256 entries."""
    digits = F.lower(F.hex(code))
    return F.concat(*[F.substring(digits, 4 * p + 1, 2) for p in range(parts)])
