"""SimHash, chat, toxicity, packing, the language model and the graph search."""

import hashlib
import inspect
import math
import random
import re
import tracemalloc
import uuid
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from docs_for_tests import make_docs
from pyspark.sql import functions as F

from sparklog.llm import ann, chat, lm, packing, queries, simhash, toxicity

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ------------------------------------------------------------------ SimHash

def _print(text, n=3):
    w = _WORDS.findall(_lower(text))
    if not w:
        return 0
    s = [" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(prints, limit):
    label = {p: p for p in prints}
    def root(p):
        while label[p] != p:
            p = label[p]
        return p
    for a, b in combinations(prints, 2):
        if bin(a ^ b).count("1") <= limit:
            label[root(a)] = root(b)
    return {p: root(p) for p in prints}


def test_components_like_all_pairs(docs):
    rows = make_docs()
    got = simhash.near_duplicates(docs).select("doc_id", simhash.as_hex(F.col("fingerprint")), "component_id").collect()
    prints = {r[:2]: _print(r[1]) for r in rows}
    roots = _components(set(prints.values()), 2)
    smallest = {}
    for (i, _), p in prints.items():
        if i is not None:
            smallest[roots[p]] = min(i, smallest.get(roots[p], i))
    want = [(r[0], f"{prints[r[:2]]:016x}", smallest.get(roots[prints[r[:2]]])) for r in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("most", [5, 20_000])
def test_links_of_clustered_fingerprints(spark, most):
    rng = random.Random(3)
    prints = {0}
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(25):
            prints.add(p)
            for _ in range(rng.randint(1, 3)):
                p ^= 1 << rng.randrange(64)
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    labels = simhash.components(simhash.links(df, most=most))
    got = {}
    for r in labels.collect():
        got.setdefault(r["label"], set()).add(r["node"] % (1 << 64))
    want = {}
    for p, r in _components(prints, 2).items():
        want.setdefault(r, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long").repartition(5)
    labels = {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    assert all(labels[i] == 0 for i in range(301)) and labels[1001] == 1000


def test_permuted_chains_are_one_component():
    path = [0, 9, 3, 6, 5, 4, 7, 2, 8, 1]
    assert not simhash._roots(np.array(path[:-1]), np.array(path[1:]), 10).any()
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(2, 60))
        path, order = rng.permutation(n), rng.permutation(n - 1)
        assert not simhash._roots(path[:-1][order], path[1:][order], n).any()
    # Neighbours of a chain are two bits apart, all others more; its order is not the index's.
    for _ in range(30):
        chain, p = [], 0
        for bits in rng.permutation(48)[:46].reshape(-1, 2):
            chain.append(p)
            p ^= int((1 << int(bits[0])) | (1 << int(bits[1])))
        prints = np.array(chain, np.uint64)[rng.permutation(len(chain))]
        a, b = simhash.local_links(np.zeros(len(prints), np.int64), prints, 2)
        roots = _components(chain, 0)
        for x, y in zip(a.tolist(), b.tolist()):
            low, high = sorted((roots[x], roots[y]))
            roots = {k: low if v == high else v for k, v in roots.items()}
        assert len(set(roots.values())) == 1


def test_one_of_each_group_stays(docs, no_docs):
    out = simhash.keep_first(docs)
    assert out.columns == docs.columns
    kept = Counter(r["doc_id"] for r in out.collect())
    assert kept[0] == 1 and not {900, 901} & set(kept) and kept[903] == 1 and kept[None] == 1
    assert simhash.keep_first(no_docs).count() == 0 and simhash.near_duplicates(no_docs).count() == 0


def test_pipeline_stage_keeps_the_first_of_each_simhash_component(spark):
    import corpus_pipeline
    rng = random.Random(6)
    rows = []
    for _ in range(20):
        text = [f"w{rng.randrange(5000)}" for _ in range(400)]
        for edits in (0, 0, 1, 1, 2, 5, 40):
            copy = list(text)
            for at in rng.sample(range(400), edits):
                copy[at] = f"e{rng.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(copy), 1, "md", 3))
    rows += [(990, None, 1, "md", 3), (991, "", 1, "md", 3)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, own_md5 int, label string, fingerprint int").repartition(5)
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
    label = {r[0]: r[0] for r in rows}
    prints = {r[0]: simhash.fingerprint(r[1]) for r in rows}
    for i, j in combinations(label, 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 2:
            low, high = sorted((label[i], label[j]))
            label = {k: low if v == high else v for k, v in label.items()}
    assert kept.columns == df.columns
    assert {tuple(r) for r in kept.collect()} == {r for r in rows if r[0] in set(label.values())}
    assert 20 < len(set(label.values())) < len(rows) - 25


# ------------------------------------------------------------------ chat

TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", "</turn>\n<turn>assistant\n\\"), (1, 2, "assistant", ""), (2, None, None, None), (2, 1, "assistant", "é🙂\\n"),
         (3, 5, "a\nb\\n<turn>", "\\\\</turn>\\"), (3, 5, "a", "tie"), (3, 5, "a", "tie"), (None, 1, "assistant", "none"), (None, 2, "user", "x" * 20_000), (4, 1, "user", None)]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*t, "clash") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    convs = {}
    for c, t, r, x in sorted(TURNS, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        data = got[c]["formatted"].encode()
        assert chat.parse(data) == turns and got[c]["n_turns"] == len(turns)
        said = [chat.unescape(data[a:b].decode()) for a, b in zip(got[c]["loss_start"], got[c]["loss_end"])]
        assert said == [x for r, x in turns if r == "assistant"]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_conversation_over_batches():
    rows = [(1, "user", "a" * i) for i in range(5)] + [(2, "assistant", "b")] * 3
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + 2]), (pa.int64(), pa.string(), pa.string()))], ["c", "r", "t"]) for i in range(0, 8, 2)]
    out = pa.Table.from_batches(chat._format(iter(batches))).to_pylist()
    assert [chat.parse(r["formatted"].encode()) for r in out] == [[("user", "a" * i) for i in range(5)], [("assistant", "b")] * 3]


# ------------------------------------------------------------------ toxicity

def _labelled(n=600, seed=1):
    rng = random.Random(seed)
    plain, bad = [f"w{i}" for i in range(40)], ["vile", "awful", "nasty"]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = rng.choices(plain, k=rng.randint(3, 30)) + ([rng.choice(bad)] if toxic else [])
        # In the labels one group is named more often with abuse.
        if rng.random() < (0.8 if toxic else 0.1):
            words.append("muslims")
        rng.shuffle(words)
        docs.append((i, " ".join(words).title()))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_neutral_mentions(spark):
    docs, labels = _labelled()
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (3, None), (99_999, 1)], "doc_id long, toxic int")
    fair = toxicity.fit(d, l, ~toxicity.held_out())
    scored = toxicity.score(d.withColumn("score", F.lit("clash")), fair).join(l.na.drop(), "doc_id").where(toxicity.held_out()).collect()
    assert len(scored) > 60 and sum(r["predicted"] == r["toxic"] for r in scored) >= 0.97 * len(scored)
    free = toxicity.fit(d, l, ~toxicity.held_out(), penalty=0.0)
    neutral = "w1 w2 Muslims w3"
    assert toxicity.logit(neutral, fair.weights, fair.bias) < toxicity.logit(neutral, free.weights, free.bias) - 0.5
    again = toxicity.fit(d.repartition(5), l, ~toxicity.held_out())
    assert again == fair
    kept = {r["doc_id"] for r in toxicity.reject_toxic(d, l).collect()}
    assert sum((i in kept) == (not t) for i, t in labels) > 0.97 * len(labels)


def test_toxicity_of_odd_rows(docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, none)).collect()
    assert len(rows) == len(make_docs()) and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 for r in rows)
    assert toxicity.score(no_docs, toxicity.fit(no_docs, none)).count() == 0


# ------------------------------------------------------------------ packing

SPACED = ["a  b", " a", "a ", "a\n b", "a \nb", "\n\n a", "a   b", "\t x", "it's <|endoftext|> here<|endoftext|> x", "don't stop' 's x's. y'll, z'!! a.b c..d e\u0301. f² 12. _a_ é, ´a` <|endoftext|>. \u00a0b \u2003 c", " ", "  ", "x" * 9000]


@pytest.mark.parametrize("size, powers", [(64, True), (64, False), (1024, True)])
def test_packing(spark, size, powers):
    from tokenizers import Tokenizer
    rows = [(r[0], r[1]) for r in make_docs()] + [(2000 + i, t) for i, t in enumerate(SPACED)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, length int").repartition(3)
    got = packing.pack(df, queries.tokenizer(), size=size, powers_of_two=powers).collect()
    tokenizer = Tokenizer.from_file(queries.tokenizer())
    want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in rows)
    ids_of = lambda r: tuple(np.frombuffer(r["ids"], "<u4"))
    pieces, sequences = {}, {}
    for r in got:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(ids_of(r)) == r["length"]
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, tokens in want:
        if want[i, tokens] == 1 and i is not None:
            parts = sorted(pieces[i], key=lambda r: r["start"])
            assert tuple(x for p in parts for x in ids_of(p)) == tokens and [p["start"] for p in parts] == [sum(q["length"] for q in parts[:k]) for k in range(len(parts))]
    assert sum(r["length"] for r in got) == sum(len(t) * n for (_, t), n in want.items())
    fills = []
    for parts in sequences.values():
        parts.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in parts] == [sum(q["length"] for q in parts[:k]) for k in range(len(parts))]
        fills.append(sum(p["length"] for p in parts))
    short = [f for f in fills if f < size]
    assert max(fills) <= size and (all(f & (f - 1) == 0 for f in short) if powers else len(short) <= 3)


def test_placement_minimises_the_sum_of_squares():
    rng, closed = random.Random(1), []
    packer = packing.Packer(10, closed.append)
    counts = Counter()
    for _ in range(500):
        n = rng.choice([2, 3, 5, 7])
        packer.place("x", n)
        after = {h: c for h, c in enumerate(packer.counts) if c}
        options = []
        for level in [0, *counts]:
            if level + n <= 10:
                new = counts.copy()
                if level:
                    new[level] -= 1
                if level + n < 10:
                    new[level + n] += 1
                options.append(sum(c * c for c in new.values()))
        assert sum(c * c for c in after.values()) == min(options)
        counts = Counter(after)


def test_packing_no_rows(no_docs):
    assert packing.pack(no_docs, queries.tokenizer()).count() == 0


# ------------------------------------------------------------------ language model

def test_gradient_like_finite_differences():
    rng = np.random.default_rng(1)
    net = lm.Network(head=7, hidden=4, bin_size=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids = rng.integers(0, 7 + lm._FORMS, (5, 3))
    first = rng.random((5, 3)) < 0.3
    real = rng.random((5, 3)) < 0.9
    state = rng.standard_normal((3, 4))
    _, g, _ = net.gradient(ids, first, real, state)
    for key, value in net.p.items():
        flat, grad = value.reshape(-1), g[key].reshape(-1)
        for i in rng.choice(len(flat), min(12, len(flat)), replace=False):
            old, h = flat[i], 1e-5
            flat[i] = old + h
            up = net.gradient(ids, first, real, state)[0]
            flat[i] = old - h
            down = net.gradient(ids, first, real, state)[0]
            flat[i] = old
            assert grad[i] == pytest.approx((up - down) / (2 * h), abs=2e-5), key


def test_states_cross_windows_and_probabilities_add_up():
    net = lm.Network(head=10, hidden=5, bin_size=4, seed=3)
    rng = np.random.default_rng(2)
    lengths = np.array([1, 40, 7, 90, 3])
    ids = rng.integers(0, 10 + lm._FORMS, lengths.sum())
    got = lm.run(net, ids, lengths, n_lanes=2, chunk=8)
    at = 0
    for n in lengths:
        state = np.zeros((1, 5), np.float32)
        for t in range(at, at + n):
            every = net.log_probs(np.repeat(state, 10 + lm._FORMS, 0), np.arange(10 + lm._FORMS))
            assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)
            assert got[t] == pytest.approx(every[ids[t]], abs=1e-4)
            state, _ = net.step(net.p["x"][ids[t:t + 1]], state)
        at += n


def test_memory_follows_tokens_beside_one_long_text():
    net = lm.Network(head=10, hidden=4, bin_size=4)
    lengths = np.array([20_000] + [2] * 511)
    ids = np.random.default_rng(2).integers(0, 10 + lm._FORMS, lengths.sum())
    tracemalloc.start()
    got = lm.run(net, ids, lengths)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Steps times lanes would take 92 MB.
    assert peak < 10e6 and (got < 0).all()


def test_windows_use_memory_again():
    net = lm.Network(head=2_048)
    rng = np.random.default_rng(3)
    ids, first, real = rng.integers(0, 2_048 + lm._FORMS, (32, 128)), np.zeros((32, 128), bool), np.ones((32, 128), bool)
    state = np.zeros((128, 32), np.float32)
    net.gradient(ids, first, real, state)
    tracemalloc.start()
    net.gradient(ids, first, real, state)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # New arrays for each step and each logit took more than 10 MB a window.
    assert peak < 5e6


def test_forms_are_found_once_by_the_part(docs):
    for part in lm.split_corpus(docs).collect():
        head_words = [*part["vocab"][:5], "is in no text"]
        place = {w: i for i, w in enumerate(head_words)}
        got = lm.model_ids(pa.array(part["vocab"], pa.string()), part["forms"], head_words)
        assert got.tolist() == [place.get(w, 6 + lm.form(w)) for w in part["vocab"]]


@pytest.mark.parametrize("scale", [1, 300])
def test_probabilities_of_small_and_great_logits(scale):
    net = lm.Network(head=10, hidden=5, bin_size=4, seed=3)
    for k in ("c", "w"):
        net.p[k] *= scale
    rng = np.random.default_rng(4)
    ids, states = rng.integers(0, 10 + lm._FORMS, 900), rng.uniform(-1, 1, (900, 5)).astype(np.float32)
    p = {k: v.astype(float) for k, v in net.p.items()}
    softmax = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
    want = [softmax(s @ p["c"] + p["cb"])[c] + (softmax(s @ p["w"][c] + p["wb"][c])[i % 4] if i < 10 else 0)
            for i, s, c in zip(ids, states, net.classes(ids))]
    assert net.bounded(net.p["c"], net.p["cb"]) == (scale == 1)
    assert net.log_probs(states, ids) == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_scores(docs, no_docs):
    rows = make_docs()
    got = lm.score(docs, head=24, hidden=8, epochs=2, window=8).collect()
    counts = Counter()
    tokens = lambda t: [*_WORDS.findall(_lower(t)), "\n"]
    out = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 10 == 0
    for i, t, *_ in rows:
        if not out(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
    want = sorted((str(i), out(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(base(t), 6)) for i, t, *_ in rows)
    assert sorted((str(r[0]), *r[1:5], round(r[5], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lm.score(no_docs).count() == 0


def test_sizes_of_the_model():
    sizes = {k: p.default for k, p in inspect.signature(lm.score).parameters.items()}
    assert (sizes["head"], sizes["hidden"], sizes["epochs"]) == (2_048, 32, 3)


def test_training_takes_every_token(spark, monkeypatch, tmp_path):
    # One text longer than the former limit of tokens, and more documents than the former limit.
    docs = spark.createDataFrame([(i, "a b") for i in range(4_500)] + [(5_000, "x y z " * 520_000)], "doc_id long, text string").repartition(3)
    learned = docs.where(~lm.held_out())
    want = learned.count() + learned.selectExpr("sum(size(split(trim(text), ' ')))").first()[0]
    assert learned.where("doc_id = 5000").count() == 1

    def count(net, ids, lengths, *_):
        assert len(ids) == lengths.sum()
        (tmp_path / uuid.uuid4().hex).write_text(f"{len(lengths)} {len(ids)}")
    monkeypatch.setattr(lm, "train", count)
    parts = lm.split_corpus(docs)
    # In this process, as the workers don't see the replaced function.
    monkeypatch.setattr(type(parts), "mapInArrow", lambda frame, f, schema: spark.createDataFrame(
        [(b.column(0)[0].as_py(),) for b in f(pa.Table.from_pylist([r.asDict() for r in frame.collect()]).to_batches())], schema))
    lm.fit(parts, ["a", "b", "\n"], np.ones(1 + lm._FORMS), want, 4, 32, 2)
    seen = np.array([[int(x) for x in f.read_text().split()] for f in tmp_path.iterdir()])
    assert seen.sum(axis=0).tolist() == [2 * learned.count(), 2 * want]


def test_unseen_texts_are_likelier_than_by_single_words(spark):
    rng = random.Random(8)
    follow = {f"w{i}": [f"w{(3 * i + j) % 40}" for j in range(2)] for i in range(40)}
    rows = []
    for i in range(300):
        text = [f"w{rng.randrange(40)}"]
        while len(text) < 40:
            text.append(rng.choice(follow[text[-1]]))
        rows.append((i, " ".join(text)))
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), head=32, hidden=24, epochs=12, window=8).where("held_out").collect()
    assert len(got) > 10 and sum(r["score"] for r in got) > 0.8 * sum(r["base_score"] for r in got)


# ------------------------------------------------------------------ graph search

def _vectors(n=900, dim=12, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((9, dim))
    x = (centres[rng.integers(0, 9, n)] + 0.4 * rng.standard_normal((n, dim))).astype(np.float32)
    x[100:140] = x[100]
    return x


def test_recall_and_scores(spark):
    x = _vectors()
    rows = [(i, [float(y) for y in v], "clash") for i, v in enumerate(x)]
    rows += [(2000, None, ""), (2020, [0.0] * 12, ""), (2040, [float("nan")] * 12, ""), (2060, [None] * 12, ""), (2080, [1.0] * 5, ""), (2081, [2.0] * 5, ""),
             (None, rows[3][1], ""), rows[7], rows[40], (2100, [float("inf")] * 12, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=300, block_rows=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {*range(0, 900, 20), 2080} and [y[:2] for y in got[2080]] == [(1, 2081)]
    d, hit = x.astype(float), 0
    for q in range(0, 900, 20):
        s = d @ d[q]
        want = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        ids = [i for _, i, _ in got[q]]
        assert [r for r, _, _ in got[q]] == list(range(1, 21)) and q not in ids and len(set(ids)) == 20
        assert all(v == pytest.approx(s[i], rel=1e-12) for _, i, v in got[q])
        hit += len(set(ids) & set(want))
    assert hit >= 0.95 * 20 * 45
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("length", [3e4, 3e38])
def test_one_huge_vector_hides_no_others(spark, length):
    x = _vectors().astype(float)
    x[555] *= length / np.abs(x[555]).max()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, hit = {}, 0
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    for q in range(0, 900, 20):
        s = x @ x[q]
        want = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        assert len(got[q]) == 20 and all(v == pytest.approx(s[i], rel=1e-12) for i, v in got[q].items())
        hit += len(set(got[q]) & set(want))
    assert hit >= 0.95 * 20 * 45


def test_copies_go_to_the_smallest_ids(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(60, [2.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 40).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [60, *range(19)]


# ------------------------------------------------------------------ the pipeline

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    docs, labels = _labelled(120)
    docs = [(i, t + (" at 10.1.2.3" if i % 7 == 0 else ""), "en", f"s{i % 3}", len(t)) for i, t in docs]
    docs += [(500, docs[0][1], "en", "s0", 1), (501, None, None, None, None), (502, "", "en", "s1", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in frame.collect()}
        stage(spark, frame, str(tmp_path)).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            after = {r["doc_id"]: r["text"] for r in frame.collect()}
            assert set(after) <= set(before)
        if name == "near_duplicates":
            assert 500 not in after and 502 not in after
        if name == "personal_data":
            assert all(after[i] == (t and t.replace("10.1.2.3", "[IP]").replace("At [IP]", "At [IP]")) for i, t in before.items())
    want = Counter({i: t for i, t in before.items()})
    assert {r["doc_id"] for r in frame.collect()} == set(want)
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.count() == frame.count()


def test_digest_query_of_chat(spark, tmp_path):
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in queries.op8_chat_format(spark, str(tmp_path)).collect()}
    text = r"\### Assistant: </turn> ok"
    assert got[-7]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and got[-7]["n_turns"] == 2
