"""Vector codes and clusters against plain Python, and shards against what they must be."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparklog.llm import clusters, codes, sharding

VECTORS = "vec_id long, embedding array<float>, label int, v int, code string, near int, slot int, _label int"


def make_vectors(n=150, length=64, seed=3, step=1 / 64):
    """Vectors on a coarse grid, so that ties are frequent, with odd rows; further columns have the operators' names."""
    rng = random.Random(seed)
    rows = [(i * 7 % 1000, [rng.randrange(-6, 7) * step for _ in range(length)], rng.choice([None, 1, 2, 3]), 1, "c", 2, 3, 4) for i in range(n)]
    rows += [rows[5 % n], rows[5 % n], (None, rows[7 % n][1], None, *rows[0][3:])]
    odd = [None, [0.1] * (length - 1) + [None], [float("nan")] * length, [float("inf")] + [0.0] * (length - 1), []]
    return rows + [(2000 + i, v, 1, *rows[0][3:]) for i, v in enumerate(odd)]


def _ok(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def _clamped(x, scale, far):
    return math.floor(scale * max(-far, min(far, x)))


def _dist(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def _lloyd(points, book, rounds):
    def assign():
        return [min((_dist(p, c), i) for i, c in enumerate(book)) for p in points]
    for _ in range(rounds):
        members = defaultdict(list)
        for p, (_, i) in zip(points, assign()):
            members[i].append(p)
        book = [[sum(xs) // len(xs) for xs in zip(*members[i])] if members[i] else c for i, c in enumerate(book)]
    return assign(), book


def _by_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def brute_codes(rows, parts, entries, rounds, scale=256):
    every = _by_order([r for r in rows if _ok(r[1])])
    length = next(len(r[1]) for r in every if r[1] and len(r[1]) % parts == 0)
    kept, other, width = [r for r in every if len(r[1]) == length], [r for r in every if len(r[1]) != length], length // parts
    whole = [[_clamped(x, scale, 2.0 ** 50) for x in r[1]] for r in kept]
    got = [_lloyd([w[p * width:(p + 1) * width] for w in whole], [w[p * width:(p + 1) * width] for w in whole[:entries]], rounds) for p in range(parts)]
    books = ",".join(str(x) for _, book in got for e in book for x in e)
    out = [(r[0], "".join(f"{got[p][0][i][1]:02x}" for p in range(parts)), sum(got[p][0][i][0] for p in range(parts)), r[2]) for i, r in enumerate(kept)]
    labels = Counter()
    for _, _, error, label in out:
        labels[label] += error
    fits = lambda n: n if n < 2 ** 63 else None
    known = {x for _, _, _, x in out}
    out += [(r[0], None, None, r[2]) for r in other]
    return Counter((i, c, e and fits(e), fits(labels[x]) if x in known else None) for i, c, e, x in out), hashlib.sha256(books.encode()).hexdigest()


def run_codes(df, **options):
    found, books = codes.fit(df, **options)
    rows = codes.with_errors(found).select("vec_id", codes.as_hex(F.col("code"), books.parts).alias("code"), "error", "label_error").collect()
    return Counter(map(tuple, rows)), books.sha256()


@pytest.mark.parametrize("entries,rounds,step", [(64, 2, 1 / 64), (64, 4, 1 / 256), (5, 3, 1.0)])
def test_codes_equal_brute_force(spark, entries, rounds, step):
    rows = make_vectors(step=step)
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    assert run_codes(df, entries=entries, rounds=rounds) == brute_codes(rows, 16, entries, rounds)


def test_codes_of_few_vectors_and_of_large_numbers(spark):
    rows = make_vectors(20, 32, step=3.0e6)
    assert run_codes(spark.createDataFrame(rows, VECTORS)) == brute_codes(rows, 16, 64, 2)
    far = make_vectors(30, 16, step=2.0 ** 40)
    far[3] = (far[3][0], [3.0e38] + [0.0] * 15, 2, *far[3][3:])
    got, digest = run_codes(spark.createDataFrame(far, VECTORS), entries=4)
    want, wanted = brute_codes(far, 16, 4, 2)
    assert digest == wanted and {(i, c) for i, c, _, _ in got} == {(i, c) for i, c, _, _ in want}
    assert {(i, e) for i, _, e, _ in got} == {(i, e) for i, _, e, _ in want}


def test_codes_of_no_vectors_and_of_other_lengths(spark):
    none, books = codes.fit(spark.createDataFrame([], VECTORS))
    assert books is None and codes.with_errors(none).collect() == []
    odd, books = codes.fit(spark.createDataFrame([(1, [1.0] * 7, 1)], "vec_id long, embedding array<float>, label int"))
    assert books is None and [tuple(r) for r in codes.with_errors(odd).select("vec_id", "code", "error").collect()] == [(1, None, None)]
    rows = make_vectors(40, 32)
    mixed = rows + [(5000, [1.0] * 16, 1, *rows[0][3:]), (5001, [1.0] * 7, 1, *rows[0][3:])]
    got, digest = run_codes(spark.createDataFrame(mixed, VECTORS))
    assert (got, digest) == brute_codes(mixed, 16, 64, 2) and {(5000, None, None), (5001, None, None)} < {r[:3] for r in got}


def test_idle_parts_keep_the_lower_index_in_ties():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = rng.integers(-3, 4, (40, 2)).astype(float)
        before = rng.integers(-3, 4, (9, 2)).astype(float)
        after = np.where(rng.random((9, 1)) < 0.4, rng.integers(-3, 4, (9, 2)), before).astype(float)
        code, dist = codes._nearest(x, before)
        codes.reassign(x, after, (after != before).any(axis=1), code, dist)
        want, near = codes._nearest(x, after)
        assert (code == want).all() and (dist == near).all()


def brute_clusters(rows, k, rounds, scale=64):
    kept = [r for r in rows if _ok(r[1]) and len(r[1]) == 64]
    whole = [[_clamped(x, scale, 2.0 ** 45) for x in r[1]] for r in kept]

    def order(i):
        key = kept[i][0]
        return key is None, hashlib.sha256(f"1:{key}".encode()).hexdigest(), whole[i]
    start = sorted(range(len(kept)), key=order)[:k]
    near, book = _lloyd(whole, [whole[i] for i in start], rounds)
    sums = Counter()
    for d, i in near:
        sums[i] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in book]
    fits = lambda n: n if n < 2 ** 63 else None
    return Counter((r[0], i, fits(d), fits(sums[i]), fits(sum(sums.values())), digest[i]) for r, (d, i) in zip(kept, near))


@pytest.mark.parametrize("step,k", [(1 / 64, 16), (1 / 8, 5), (0.37, 16), (2.0 ** 20, 6)])
def test_clusters_equal_brute_force(spark, step, k):
    rows = make_vectors(step=step)
    rows.append((6000, [1.0] * 63, 1, *rows[0][3:]))
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = clusters.with_inertia(*clusters.cluster(df, clusters=k)).collect()
    assert Counter(map(tuple, got)) == brute_clusters(rows, k, 3)


def test_clusters_of_few_far_and_no_vectors(spark):
    rows = make_vectors(4)
    got = clusters.with_inertia(*clusters.cluster(spark.createDataFrame(rows, VECTORS))).collect()
    assert Counter(map(tuple, got)) == brute_clusters(rows, 16, 3)
    rows = make_vectors(30)
    rows.append((7000, [3.0e38] * 64, 1, *rows[0][3:]))
    got = clusters.with_inertia(*clusters.cluster(spark.createDataFrame(rows, VECTORS), clusters=4)).collect()
    want = brute_clusters(rows, 4, 3)
    assert {r[:2] for r in map(tuple, got)} == {r[:2] for r in want}
    empty = clusters.with_inertia(*clusters.cluster(spark.createDataFrame([], VECTORS)))
    assert empty.collect() == [] and len(empty.columns) == 6


def test_clusters_need_no_python_workers(spark):
    plan = clusters.with_inertia(*clusters.cluster(spark.createDataFrame(make_vectors(20), VECTORS).repartition(2)))
    assert "Python" not in plan._jdf.queryExecution().toString() and "Arrow" not in plan._jdf.queryExecution().toString()


# -------------------------------------------------------------------- shards

def _shards(docs, n=24, **options):
    return sharding.shards(docs, n, **options).select("shard", "slot", "record").collect()


def test_shards_hold_every_record_once_in_equal_counts(spark, docs):
    got = _shards(docs, bucket_bytes=4000)
    assert Counter(r["record"] for r in got) == Counter(docs.collect())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_agree_between_runs_and_follow_the_seed(spark, docs):
    at = lambda **o: {(r["shard"], r["slot"], r["record"]) for r in _shards(docs, **o)}
    assert at(bucket_bytes=4000) == at(bucket_bytes=4000)
    assert at(seed=1) != at(seed=2)


def test_equal_records_spread_over_buckets(spark):
    same = spark.createDataFrame([(None, "same text", 1, 2)] * 3000, "doc_id long, text string, record int, bucket int").repartition(3)
    found = sharding.external_shuffle(same, bucket_bytes=3400)
    sizes = [r["count"] for r in found.groupBy("bucket").count().collect()]
    assert len(sizes) == 15 and max(sizes) < 2 * 3000 / 15
    assert Counter(r["record"] for r in _shards(same, 7)) == Counter(same.collect())


def test_a_bucket_is_in_random_order(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    found = sharding.external_shuffle(docs, bucket_bytes=1 << 20).select("rank", "record.doc_id").collect()
    order = [r["doc_id"] for r in sorted(found)]
    assert sorted(order) == list(range(4000)) and abs(np.corrcoef(order, range(4000))[0, 1]) < 0.08


def test_shards_of_few_and_no_records(spark, no_docs):
    assert _shards(no_docs) == []
    few = spark.createDataFrame([(1, None), (2, "x" * 100_000), (3, "")], "doc_id long, text string")
    assert len({r["shard"] for r in _shards(few, bucket_bytes=100)}) == 3


def test_written_shards_are_read_back(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), 5, bucket_bytes=4000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(tuple, back.drop("shard").collect())) == Counter(map(tuple, docs.collect()))
    counts = [r["count"] for r in back.groupBy("shard").count().collect()]
    assert len(counts) == 5 and max(counts) - min(counts) <= 1
