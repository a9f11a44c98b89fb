"""Nearest neighbours by largest inner product on robust-pruned directed graphs.

Vectors get one more component, ``sqrt(M^2 - |x|^2)`` with M the largest length, and queries a zero
there: the nearest by distance is then the one of largest inner product. Equal vectors are one
node, which knows its smallest ids. Nodes are dealt into shards of bounded size by bands of their lengths, a
factor of 16 each, and by their hash. M is the shard's own, and its vectors are divided by it, so that lengths far apart
cost no precision. Each shard becomes a graph: points are added in batches of growing size, a greedy beam search from the medoid
over the graph so far proposes neighbours, and relaxed pruning keeps a neighbour only if no kept one
is nearer to it than ``1 / alpha`` of its distance, so that edges stay diverse. Edges go both ways and are
pruned again where a node has too many.

Queries go to every shard in blocks of bounded size; each block searches a shard's graph by beam
search, all its queries in step, and the best of all shards are merged. The scores are inner
products of the original vectors in double precision.

Bounds: a task holds one shard (``shard_rows`` nodes) and one block of queries (``block_rows``). Graphs are
written to the shared folder. Copies beyond the ``k + 1`` smallest ids of a vector can't be among
the k nearest, ties going to smaller ids, and are left out before the shuffle.

Defined results: vectors that are null, zero, or hold a null or a component that is not finite take no
part, neither do rows without an id; vectors only meet those of their length; repeated rows are one row; with
fewer candidates than k all are returned; columns other than the id and the vector are not read; an
empty table gives an empty one.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import scratch
from .text import let


# ------------------------------------------------------------------ graphs

def _distances(points: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own row of ids; -1 is no node."""
    diff = points[ids] - queries[:, None, :]
    out = np.einsum("qcd,qcd->qc", diff, diff)
    return np.where(ids >= 0, out, np.inf)


def beam_search(points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int,
                keep_visited: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes found for each query, nearest first, and their squared distances;
    with ``keep_visited`` all nodes that were looked at on the way as well."""
    n = len(queries)
    ids = np.full((n, beam), -1)
    dist = np.full((n, beam), np.inf)
    ids[:, 0] = entry
    dist[:, 0] = _distances(points, ids[:, :1], queries)[:, 0]
    expanded = np.zeros((n, beam), bool)
    seen = np.zeros((n, len(points)), bool)
    seen[:, entry] = True
    visited, active = [], np.arange(n)
    while len(active):
        open_ = np.where(expanded[active] | (ids[active] < 0), np.inf, dist[active])
        # Several of the nearest are expanded in a step.
        best = np.argsort(open_, axis=1, kind="stable")[:, :4]
        ok = np.take_along_axis(open_, best, 1) < np.inf
        active, best, ok = active[ok[:, 0]], best[ok[:, 0]], ok[ok[:, 0]]
        if not len(active):
            break
        node = np.where(ok, ids[active[:, None], best], -1)
        expanded[active[:, None], best] |= ok
        if keep_visited:
            full = np.full((n, node.shape[1]), -1)
            full[active] = node
            visited.append(full)
        near = np.where(node[:, :, None] >= 0, edges[node], -1).reshape(len(active), -1)
        # A node reached twice in a step counts once.
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        fresh = (near >= 0) & ~seen[active[:, None], near]
        near = np.where(fresh, near, -1)
        seen[active[:, None], np.where(fresh, near, entry)] = True
        both = np.concatenate([ids[active], near], axis=1)
        both_d = np.concatenate([dist[active], _distances(points, near, queries[active])], axis=1)
        both_e = np.concatenate([expanded[active], np.zeros(near.shape, bool)], axis=1)
        top = np.argsort(both_d, axis=1, kind="stable")[:, :beam]
        ids[active], dist[active] = np.take_along_axis(both, top, 1), np.take_along_axis(both_d, top, 1)
        expanded[active] = np.take_along_axis(both_e, top, 1)
    ids = np.where(np.isfinite(dist), ids, -1)
    if keep_visited:
        ids = np.concatenate([ids, *visited], axis=1)
        dist = _distances(points, ids, queries)
    return ids, dist


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` of each node's candidates, nearest first; one that lies nearer to a kept one than
    ``1 / alpha`` of its distance to the node is left out."""
    candidates = np.sort(np.where(candidates == nodes[:, None], -1, candidates), axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    dist = _distances(points, candidates, points[nodes])
    order = np.argsort(dist, axis=1, kind="stable")[:, :4 * degree]
    candidates, dist = np.take_along_axis(candidates, order, 1), np.take_along_axis(dist, order, 1)
    vectors = points[candidates]
    left = dist.copy()
    out = np.full((len(nodes), degree), -1)
    row = np.arange(len(nodes))
    for k in range(degree):
        best = np.argmin(left, axis=1)
        ok = np.isfinite(left[row, best])
        if not ok.any():
            break
        out[ok, k] = candidates[row, best][ok]
        diff = vectors - vectors[row, best][:, None, :]
        between = np.einsum("qcd,qcd->qc", diff, diff)
        left[(alpha * alpha * between <= dist) & ok[:, None]] = np.inf
        left[row, best] = np.inf
    return out


def build_graph(points: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2) -> tuple[np.ndarray, int]:
    """Edges (nodes x degree, -1 where none) and the node where searches begin."""
    n = len(points)
    entry = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
    edges = np.full((n, degree), -1)
    order = np.random.default_rng(0).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    done = 1
    while done < n:
        batch = order[done:done + min(max(1, done), 512)]
        found, _ = beam_search(points, edges, entry, points[batch], beam, keep_visited=True)
        edges[batch] = robust_prune(points, batch, found, degree, alpha)
        # The new edges' other direction.
        to = edges[batch]
        source = np.repeat(batch, degree)[to.ravel() >= 0]
        target = to.ravel()[to.ravel() >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        for begin in range(0, len(heads), 512):
            h, f, c = (x[begin:begin + 512] for x in (heads, first, count))
            new = np.full((len(h), int(c.max())), -1)
            at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            new[np.repeat(np.arange(len(h)), c), at] = source[np.repeat(f, c) + at]
            both = np.concatenate([edges[h], new], axis=1)
            over = (both >= 0).sum(axis=1) > degree
            if over.any():
                edges[h[over]] = robust_prune(points, h[over], both[over], degree, alpha)
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :degree]
            edges[h[~over]] = packed[~over]
        done += len(batch)
    return edges, entry


# ------------------------------------------------------------------ Spark

def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    big = F.lit(float("inf"))
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by the largest component of all, and their lengths: no square overflows."""
    x = x / np.abs(x).max()
    return x, np.sqrt((x * x).sum(axis=1))


def _points(x: np.ndarray) -> np.ndarray:
    x, size = _lengths(x)
    size, x = size / size.max(), x / size.max()
    return np.concatenate([x, np.sqrt(np.maximum(1 - size * size, 0))[:, None]], axis=1).astype(np.float32)


def _asked(q: np.ndarray) -> np.ndarray:
    """Queries of length 1 in the graph's space; their order of the nodes is the same."""
    q = q / np.abs(q).max(axis=1)[:, None]
    q = q / np.sqrt((q * q).sum(axis=1))[:, None]
    return np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)


def _band(v: Column) -> Column:
    """The power of 16 that is next to a vector's length."""
    def of(most):
        square = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / most) * (x / most))
        return F.floor((F.log2(most) + F.log2(square) / 2) / 4 + 0.5)
    return let(F.array_max(F.transform(v, F.abs)), of)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, shard_rows: int = 8_192, block_rows: int = 4_096,
            degree: int = 32, beam: int = 96, alpha: float = 1.2) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for the rows of ``vectors`` (vec_id,
    embedding) for which ``queries`` holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v")).where(
        F.col("vec_id").isNotNull() & usable(F.col("v")))
    # Of equal vectors, the smallest ids: the limit works before the shuffle.
    first = rows.distinct().withColumn("_n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    nodes = scratch.write_table(first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("size", F.size("v")).withColumn(
        "band", _band(F.col("v"))), "nodes")
    # One row for each length of vectors and power of 16.
    bands = scratch.write_table(nodes.groupBy("size", "band").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("n_shards")), "bands")
    name = lambda number: F.concat_ws(":", *[x.cast("string") for x in (F.col("size"), F.col("band"), number)])
    dealt = nodes.join(F.broadcast(bands), ["size", "band"]).select("v", "ids", name(F.pmod(F.xxhash64("v"), F.col("n_shards"))).alias("shard"))

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf["v"])
        # An order of its own, whatever order the shuffle brings the rows in.
        order = np.lexsort(x.T[::-1])
        pdf, x = pdf.iloc[order].reset_index(drop=True), x[order]
        edges, entry = build_graph(_points(x), degree, beam, alpha)
        pdf["node"] = np.arange(len(x))
        pdf["edges"] = list(edges.astype(np.int32))
        pdf["entry"] = entry
        return pdf[["shard", "node", "v", "ids", "edges", "entry"]]

    index = scratch.write_table(dealt.groupBy("shard").applyInPandas(
        graph, "shard string, node long, v array<double>, ids array<long>, edges array<int>, entry long"), "graphs")
    asked = scratch.write_table(rows.where(queries).distinct().withColumnRenamed("vec_id", "query_id"), "queries")
    n_blocks = max(1, -(-asked.count() // block_rows))

    def search(graph: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(graph) or not len(ask):
            return pd.DataFrame({"query_id": [], "ids": [], "score": []}, dtype=object)
        graph = graph.sort_values("node")
        x, edges, entry = _matrix(graph["v"]), np.stack(graph["edges"].to_numpy()).astype(np.int64), int(graph["entry"].iloc[0])
        points = _points(x)
        ids, parts = graph["ids"].to_numpy(), []
        for begin in range(0, len(ask), 512):
            part = ask.iloc[begin:begin + 512]
            q = _matrix(part["v"])
            found, _ = beam_search(points, edges, entry, _asked(q), beam)
            score = np.where(found >= 0, np.einsum("qcd,qd->qc", x[found], q), -np.inf)
            top = np.argsort(-score, axis=1, kind="stable")[:, :k + 1]
            found, score = np.take_along_axis(found, top, 1), np.take_along_axis(score, top, 1)
            who, at = np.nonzero(found >= 0)
            parts.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[who], "ids": ids[found[who, at]], "score": score[who, at]}))
        return pd.concat(parts)

    blocks = F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))
    shards = bands.select("size", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_shards") - 1), name)).alias("shard"))
    ask = (asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))).withColumn("size", F.size("v"))
           .join(F.broadcast(shards), "size").select("query_id", "v", "block", "shard"))
    found = (index.select("*", F.explode(blocks).alias("block")).groupBy("shard", "block")
             .cogroup(ask.groupBy("shard", "block")).applyInPandas(search, "query_id long, ids array<long>, score double"))
    each = found.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
