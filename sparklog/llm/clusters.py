"""Clusters around centroids, with expressions of the JVM only.

Vectors become integers by ``floor(scale * x)``. The centroids are one literal: an array of integer
arrays. ``zip_with`` and ``aggregate`` give the squared distance to each, and ``array_min`` over structs
of distance and number chooses the cluster, so ties go to the smaller number. Column sums per
cluster, added up in each task before they are shuffled, move the centroids to floored means.

The driver holds the centroids and one row of sums per cluster. All rows are read in every round;
only ids, clusters and distances are written.

Numbers are exact: longs while the largest component proves that no sum of squares leaves them,
else decimals of 38 digits. A component beyond +-2^45 counts as +-2^45.

Defined results: vectors of another length, null ones and those with null or non-finite components are
left out; repeated rows count each; a null id comes last in order, and equal ids go by their vectors;
with fewer vectors than clusters there are so many clusters; a distance or sum beyond a long is null;
other columns are not read; an empty table gives an empty one.
"""

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from .. import scratch
from .codes import finite

_FARTHEST = 2.0 ** 45
_LONG = (1 << 63) - 1


def as_integers(vector: Column, scale: int, number: str) -> Column:
    def one(x):
        near = F.greatest(F.least(x.cast("double"), F.lit(_FARTHEST)), F.lit(-_FARTHEST))
        return F.floor(near * scale).cast(number)
    return F.transform(vector, one)


def _literal(centroids: list[list[int]], number: str) -> Column:
    rows = ", ".join(f"array({', '.join(f'{x}BD' for x in c)})" for c in centroids)
    return F.expr(f"cast(array({rows}) as array<array<{number}>>)")


def nearest(vector: Column, centroids: list[list[int]], number: str = "long") -> Column:
    """Struct (distance, cluster) of the nearest centroid."""
    def distance(centroid):
        squares = F.zip_with(vector, centroid, lambda a, b: ((a - b) * (a - b)).cast(number))
        return F.aggregate(squares, F.lit(0).cast(number), lambda s, x: (s + x).cast(number))
    return F.array_min(F.transform(_literal(centroids, number), lambda c, i: F.struct(
        distance(c).alias("distance"), i.alias("cluster"))))


def _assigned(vectors: DataFrame, centroids: list[list[int]], number: str) -> DataFrame:
    """``vectors`` with the struct ``near``, computed once per row."""
    near = F.array(nearest(F.col("v"), centroids, number))
    return vectors.select("*", F.explode(near).alias("near"))


def _means(assigned: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(len(centroids[0]))]
    rows = assigned.groupBy("near.cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect()  # a row per cluster
    new = list(centroids)
    for row in rows:
        new[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(len(sums))]
    return new


def _start_order(seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)


def cluster(vectors: DataFrame, clusters: int = 16, rounds: int = 3, length: int = 64, scale: int = 64,
            seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of ``vectors`` (vec_id, embedding), a written table, and the centroids.

    The first centroids are the vectors with the smallest digests of seed and id.
    """
    kept = vectors.select("vec_id", "embedding").where(finite(F.col("embedding")) & (F.size("embedding") == length))
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    most = kept.agg(F.max(largest)).first()[0]
    bound = min(float(most or 0), _FARTHEST) * scale + 1
    number = "long" if 4 * length * bound * bound < 2.0 ** 62 else "decimal(38,0)"
    whole = kept.select("vec_id", as_integers(F.col("embedding"), scale, number).alias("v"))
    order = _start_order(seed)
    start = whole.orderBy(order.isNull(), order, "v").limit(clusters).collect()
    centroids = [[int(x) for x in r["v"]] for r in start]
    if not centroids:
        return whole.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = _means(_assigned(whole, centroids, number), centroids)
    near = _assigned(whole, centroids, number).select("vec_id", "near.cluster", "near.distance")
    return scratch.write_table(near.withColumn("distance", _as_long(F.col("distance"))), "clusters"), centroids


def _as_long(d: Column) -> Column:
    return F.when(d <= _LONG, d.cast("long"))


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned`` with ``cluster_inertia``, ``inertia`` and ``centroid_sha256``."""
    known = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: int(r["s"] or 0) for r in assigned.groupBy("cluster").agg(known.alias("s")).collect()}
    fits = lambda n: F.lit(n if n <= _LONG else None).cast("long")
    by_cluster = F.array(*[fits(sums.get(i, 0)) for i in range(len(centroids))], F.lit(None).cast("long"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return assigned.select(
        "vec_id", "cluster", "distance", F.get(by_cluster, F.col("cluster")).alias("cluster_inertia"),
        fits(sum(sums.values())).alias("inertia"),
        F.get(F.array(*[F.lit(d) for d in digests], F.lit(None).cast("string")), F.col("cluster")).alias("centroid_sha256"))
