"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints: XXH64 of every word shingle, repeats included; a bit is set when it is set in over
half of the hashes. Distinct fingerprints are shuffled, not documents.

Search: two fingerprints that differ in at most ``bits`` places agree in at least
``parts - bits`` of ``parts`` equal parts, so each goes once to every choice of that many parts,
which is its key; only keys that several fingerprints share go on. A task gets its keys in order
and builds an index over them: leaves in order of Gray rank, so that neighbours differ in few bits;
every node holds the bits that all fingerprints below share and that no node above has yet, the
key's own bits being the root's. Queries go down level by level with the differences so far, and a
whole group is left when they exceed the limit. At most 2,081 fingerprints lie within two bits of
another one, so hits are in proportion to fingerprints; each task joins its hits into components and
returns one link per fingerprint.

A key that more than ``most`` fingerprints share is divided by further parts of the bits it leaves
open; with 16 bits left open, at most 65,536 distinct fingerprints can share it.

Components over all links: every fingerprint takes the smallest label among its neighbours and then
the label of that label, until nothing changes. The rounds are written to the shared folder.

Defined results: null and empty texts have fingerprint zero and are linked like any other; a text
of fewer words than a shingle is one shingle; repeated rows are members of one component; a null
doc_id is no smallest id unless all are null; columns other than doc_id and text are not read, and
``keep_first`` returns them as they are; an empty table gives an empty table.
"""

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .. import scratch
from .text import whole

SEED = 42
_CHUNK = 1 << 14
_QUERIES = 1 << 12
_TASK_ROWS = 1 << 17


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    digest, ones, n, part = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for s in shingles:
        part.append(digest(s, SEED))
        if len(part) == _CHUNK:
            ones, n, part = ones + _bits_set(part), n + len(part), []
    if part:
        ones, n = ones + _bits_set(part), n + len(part)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def _bits_set(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def with_fingerprint(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``, a long of the same bits."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))
    return docs.withColumn("fingerprint", of(F.col(f"`{text}`")))


# ------------------------------------------------------------------ the index

def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place in Gray order, so that the neighbours of a sorted list differ in few bits."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """Hierarchical index over sorted groups of fingerprints.

    ``levels[0]`` are the leaves. Each level has, per node, ``mask`` (bits shared below and not
    given by a node above), ``value`` and the range of its children.
    """

    def __init__(self, prints: np.ndarray, groups: np.ndarray, fan: int = 8):
        """``groups`` counts up from 0; group i is indexed under root i."""
        order = np.lexsort((gray_rank(prints), groups))
        self.prints, self.order, self.fan = prints[order], order, fan
        ones = np.full(len(prints), ~np.uint64(0))
        shared, values, group = [ones], [self.prints], groups[order]
        children = [None]
        while len(np.unique(group)) < len(group):
            new = np.concatenate([[True], group[1:] != group[:-1]])
            start = np.flatnonzero(new)
            place = np.arange(len(group)) - start[np.cumsum(new) - 1]
            first = np.flatnonzero(place % fan == 0)
            both = np.bitwise_and.reduceat(shared[-1], first)
            # A bit is shared when it is shared in every child and has the same value there.
            same = both & ~(np.bitwise_or.reduceat(values[-1], first) ^ np.bitwise_and.reduceat(values[-1], first))
            children.append((first, np.append(first[1:], len(group))))
            shared.append(same)
            values.append(values[-1][first])
            group = group[first]
        self.levels = []
        for k, (mask, value) in enumerate(zip(shared, values)):
            if k + 1 < len(shared):
                begin, end = children[k + 1]
                above = np.repeat(shared[k + 1], end - begin)
                mask = mask & ~above
            self.levels.append((mask, value, children[k]))

    def search(self, queries: np.ndarray, roots: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of all fingerprints within ``limit`` bits below each query's root."""
        who, node = np.arange(len(queries)), roots
        spent = np.zeros(len(queries), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            mask, value, children = self.levels[k]
            spent = spent + np.bitwise_count((queries[who] ^ value[node]) & mask[node])
            near = spent <= limit
            who, node, spent = who[near], node[near], spent[near]
            if k:
                begin, end = children
                n = end[node] - begin[node]
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                node = np.repeat(begin[node], n) + offset
                who, spent = np.repeat(who, n), np.repeat(spent, n)
        return who, node


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each node's component under the links a-b."""
    label = np.arange(n)
    while True:
        # Labels are roots here. Only roots are hooked, so ends that have met stay together.
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label != label[label]).any():
            label = label[label]


def local_links(keys: np.ndarray, prints: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """One link for each fingerprint that is in a component of several; rows come sorted by key."""
    groups = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
    index = GrayIndex(prints, groups)
    at = np.empty(len(prints), np.int64)
    at[index.order] = np.arange(len(prints))
    label = np.arange(len(prints))
    for begin in range(0, len(prints), _QUERIES):
        part = slice(begin, begin + _QUERIES)
        who, leaf = index.search(prints[part], groups[part], limit)
        label = _roots(label[at[part][who]], label[leaf], len(prints))[label]
    linked = label != np.arange(len(prints))
    return index.prints[linked], index.prints[label[linked]]


def _search_sorted(limit: int):
    """Index and search of whole keys, about ``_TASK_ROWS`` rows at a time."""
    def run(batches):
        keys, prints, rows = [], [], 0

        def done(k, p):
            a, b = local_links(k, p, limit)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            prints.append(batch.column(1).to_numpy().view(np.uint64))
            rows += batch.num_rows
            if rows >= _TASK_ROWS:
                k, p = np.concatenate(keys), np.concatenate(prints)
                cut = np.searchsorted(k, k[-1], "left")
                if cut:
                    yield done(k[:cut], p[:cut])
                keys, prints, rows = [k[cut:]], [p[cut:]], len(k) - cut
        if rows:
            yield done(np.concatenate(keys), np.concatenate(prints))
    return run


def _key(print_: Column, pick: tuple[int, ...], width: int, number: int) -> Column:
    """The chosen parts of ``width`` bits, with the number of the choice."""
    bits = F.lit(number).cast("long")
    for p in pick:
        part = F.shiftrightunsigned(print_, p * width).bitwiseAND((1 << width) - 1)
        bits = F.shiftleft(bits, width).bitwiseOR(part)
    return bits


def links(prints: DataFrame, limit: int = 2, most: int = 20_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fingerprint``) that have all components
    of fingerprints within ``limit`` bits, one for each fingerprint and task at most."""
    parts = limit + 2
    width = 64 // parts if 64 % parts == 0 else 0
    if not width or width * (parts - limit) > 56:
        raise ValueError("limit must be 2 or another number with equal parts")
    choices = list(combinations(range(parts), parts - limit))
    f = F.col("fingerprint")
    keyed = prints.select(F.explode(F.array(*[_key(f, c, width, i) for i, c in enumerate(choices)])).alias("k"), f)
    counts = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keyed.join(counts, "k")
    # Keys shared too often are divided by halves of the parts that they leave open.
    small = width // 2
    fine = list(combinations(range(2 * parts), 2 * (parts - limit) + 2))
    def finer(i, c):
        fixed = {2 * p + h for p in c for h in (0, 1)}
        return [F.xxhash64(F.lit(i), _key(f, pick, small, i)) for pick in fine if fixed <= set(pick)]
    ways = F.array("k")
    for i, c in enumerate(choices):
        ways = F.when((F.col("n") > most) & (F.shiftrightunsigned("k", width * (parts - limit)) == i), F.array(*finer(i, c))).otherwise(ways)
    return (shared.select(F.explode(ways).alias("k"), "fingerprint").repartition("k").sortWithinPartitions("k")
            .mapInArrow(_search_sorted(limit), "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of ``edges`` (a, b): label is the component's smallest node.

    A round hooks every label to the smallest label beside it and then jumps over labels, which
    takes about the logarithm of the longest chain in rounds. All groups are minima, so hot nodes
    shrink before they are shuffled.
    """
    edges = scratch.write_table(edges.distinct(), "links")
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = scratch.write_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        beside = both.join(of_b, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        hooked = labels.join(beside, "node").select("node", "label", F.least("label", "near").alias("new"))
        # The smallest label seen from any node of a label becomes the label of that label.
        lower = hooked.groupBy(F.col("label").alias("l")).agg(F.min("new").alias("down"))
        step = hooked.join(lower, F.col("label") == F.col("l")).select("node", "label", F.least("new", "down").alias("new"))
        jump = step.select(F.col("node").alias("j"), F.col("new").alias("far"))
        step = step.join(jump, F.col("new") == F.col("j"), "left").select("node", "label", F.coalesce("far", "new").alias("new"))
        step = scratch.write_table(step, "labels")
        if step.where("new <> label").isEmpty():
            return labels
        labels = step.select("node", F.col("new").alias("label"))


def near_duplicates(docs: DataFrame, shingle: int = 3, limit: int = 2, most: int = 20_000) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): ``doc_id``, ``text_md5``, ``fingerprint`` and
    ``component_id``, the smallest doc_id that links of at most ``limit`` bits reach.

    Texts are read once and never shuffled.
    """
    ids = scratch.write_table(with_fingerprint(docs.select("doc_id", "text"), shingle).select(
        "doc_id", F.md5(whole("text")).alias("text_md5"), "fingerprint"), "fingerprints")
    prints = scratch.write_table(ids.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "prints")
    labels = components(links(prints.select("fingerprint"), limit, most))
    named = prints.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "label", F.coalesce("label", "fingerprint"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_print = named.join(smallest, "label").select("fingerprint", "label", "component_id")
    # A fingerprint may belong to a large share of the documents; Spark divides such a join's parts.
    return ids.join(by_print, "fingerprint")


def as_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def keep_first_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of each ``label`` of ``found`` (doc_id, text_md5, label), the row of ``docs`` with the smallest doc_id stays,
    and the smallest digest of the text among rows of that id. A null id comes last. Rows are carried as one
    struct, so columns of any name come back as they were."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5")
    stays = found.groupBy("label").agg(F.min(first).alias("f")).select(F.col("f.doc_id").alias("stays_id"), F.col("f.text_md5").alias("stays_md5"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.col("doc_id").alias("own_id"),
                       F.md5(whole("text")).alias("own_md5"))
    return (rows.join(stays, F.col("own_id").eqNullSafe(F.col("stays_id")) & (F.col("own_md5") == F.col("stays_md5")), "left_semi")
            .dropDuplicates(["own_id", "own_md5"]).select("record.*"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the near-duplicates; of each component the row stays that ``keep_first_of`` says."""
    return keep_first_of(docs, near_duplicates(docs, **options))
