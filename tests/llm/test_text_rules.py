"""Quality rules, personal data and mixing against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparklog.llm import mixing, pii, quality, queries
from sparklog.llm.text import running_sums

from docs_for_tests import make_docs

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _repeats(w):
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i:i + 5])].append(i)
    return len({p for places in at.values() if len(places) > 1 for i in places for p in range(i, i + 5)})


def test_quality_like_plain_python(docs, by_id):
    got = by_id(quality.judge(docs.withColumn("quality", F.lit(1))).select(
        "doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines", "quality.n_repeat_words", "quality.base_failed").collect())
    want = []
    for i, t, *_ in make_docs():
        t = t or ""
        w = _WORDS.findall(t)
        lines = [x for x in t.split("\n") if _WORDS.search(x)]
        n = _repeats(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), n,
                     len(w) < 10 or 100 * n > 20 * len(w)))
    assert got == by_id(want)


def test_windows_of_equal_bits_are_compared(spark, monkeypatch):
    # With few bits of the hash, different windows meet.
    monkeypatch.setattr(quality, "_PLACE_BITS", 61)
    text = " ".join(str(i * 7919 % 53) for i in range(120)) + " a b c d e f a b c d e g"
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(quality.measures(F.col("text"))["n_repeat_words"]).first()[0]
    assert got == _repeats(text.split())


def test_quality_of_no_rows_and_verdict(spark, no_docs):
    assert quality.judge(no_docs).count() == 0
    good = "The house of the old man was on the hill and it was quiet there for a long time. " + " ".join(f"word{i} in the" for i in range(8))
    rows = [(1, good), (2, good.upper() + "!!!"), (3, " ".join(w + "###" for w in good.split())), (4, good + "\n" + "x y\n" * 30), (5, None)]
    judged = quality.judge(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r[0]: r[1] for r in judged.select("doc_id", "quality.kept").collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 1500):
        df = spark.range(1).select(F.sequence(F.lit(1), F.lit(n)).alias("a") if n else F.array().cast("array<int>").alias("a"))
        got = df.select(running_sums(F.col("a"), 256)).first()[0]
        assert got == [i * (i + 1) // 2 for i in range(1, n + 1)]


# ------------------------------------------------------------------ personal data

_PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
          "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in _PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and _luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


PERSONAL = [
    "mail a.b@c.de or x@y.z_d@e.f.g, not a@b or @c.d", "🙂 émail é.b@c.de", "1.2.3.4 1.2.3.256 1.2.3.4.5.6.7.8 0001.02.3.0255 12.34",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 378282246310005", "4111111111111111 4111111111111111", "call +1 (555) 010-9999 now, +12 or +44 20 7946 0958.",
    "+1 (826) 555-4081 190.137.223.204", "write to jane (at) mail (dot) com or call (212) 555-0187", "Dear Dr. Anna Schmidt, account DE89 3704 0044 0532 0130 00",
    "a" * 5000 + "@", "1" * 5000, "+" + "1 " * 4000, None, "", "@@@", "a@b.c" * 300,
]


def test_base_spans_like_plain_python(spark):
    df = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = {r["doc_id"]: r for r in pii.detect(df).withColumn("base", pii.in_order(F.col("spans.base"))).collect()}
    for i, text in enumerate(PERSONAL):
        assert [tuple(x) for x in got[i]["base"]] == plain_spans(text), text
    added = {(x["kind"], i) for i in got for x in got[i]["spans"]["added"]}
    assert ("email", 7) in added and ("phone", 7) in added


def test_phone_candidates_alone_in_a_document(spark):
    numbers = ["(089) 123456", "(089)123456", "089/1234567", "030/123 456", "12 345678", "212.555-0187"]
    rows = [(f"call {n} today",) for n in numbers]
    got = spark.createDataFrame(rows, "text string").select(pii.candidate_spans(F.col("text")).alias("c")).collect()
    assert [[x["s"] for x in r["c"] if x["kind"] == "phone"] for r in got] == [[n] for n in numbers]


def test_redaction(spark, no_docs):
    rows = [(1, "to x@y.de, 1.2.3.4!", 19), (2, "nothing", 7), (3, None, None)]
    out = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(1, "to [EMAIL], [IP]!", 17), (2, "nothing", 7), (3, None, None)]
    assert pii.redact(no_docs).count() == 0


def test_redaction_of_many_spans_and_of_columns_with_clashing_names(spark):
    text = "".join(f"é w{i} a{i}@b.de, 10.0.0.{i % 200} 🙂" for i in range(3000))
    rows = [(1, text, 5, 1, 2, 3), (2, "x", 5, 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int, record int, in_place int, new int")
    out = {r["doc_id"]: tuple(r) for r in pii.redact(df).collect()}
    assert out[1] == (1, "".join(f"é w{i} [EMAIL], [IP] 🙂" for i in range(3000)), 5, 1, 2, 3) and out[2] == rows[1]


def test_overlapping_spans_are_one_cut(spark):
    spans = [(0, 4, "a"), (2, 9, "b"), (3, 5, "c"), (9, 12, "d"), (20, 21, "e")] + [(30 + 2 * i, 31 + 2 * i, "f") for i in range(600)]
    df = spark.createDataFrame([(spans, "x" * 1300)], "s array<struct<start:long,end:long,kind:string>>, t string")
    row = df.select(pii._cuts(F.col("s")).alias("c"), pii._replaced(F.col("t"), pii._cuts(F.col("s"))).alias("r")).first()
    assert [tuple(c) for c in row["c"]] == [(0, 9, "a"), (9, 12, "d"), (20, 21, "e")] + spans[5:]
    assert row["r"] == "[A][D]" + "x" * 8 + "[E]" + "x" * 9 + "[F]x" * 600 + "x" * (1300 - 30 - 1200)


def test_reliabilities_and_classifier():
    # Good labelers agree on the first pattern, and on its absence in the second.
    rows = [((1, 1, 1, 0, 0), 3, 80), ((-1, -1, 0, -1, 0), 3, 200), ((1, 1, 0, 0, 1), 2, 100), ((1, -1, 0, 0, 0), 3, 10)]
    model = pii.fit_patterns(rows)
    w = dict(model.weights)
    assert w["form+"] > w["form-"] and w["gazetteer+"] > w["gazetteer-"]
    assert pii.fit_patterns([]) == pii.Model((), ())


# ------------------------------------------------------------------ mixing

def _targets(sizes, share=1.5, most=2.0):
    """Shares by weight; what is above a cap is shared again until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, active = share * sum(sizes.values()), {}, set(names)
    while active:
        total = sum(weight[s] for s in active)
        full = {s for s in active if left * weight[s] / total > most * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in active}
            break
        for s in full:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in full)
        active -= full
    return target


@pytest.mark.parametrize("shard_words, block", [(1_000_000, 16), (500, 8)])
def test_mix(docs, shard_words, block):
    rows = mixing.mix(docs, shard_words=shard_words, block=block).collect()
    again = mixing.mix(docs.repartition(7), shard_words=shard_words, block=block).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    sizes = Counter()
    for _, text, _, source, _ in make_docs():
        sizes[source] += len(_WORDS.findall(text or ""))
    want, taken = _targets(sizes), Counter()
    assert len(rows) == len(make_docs())
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        shards = -(-sizes[s] // shard_words)
        assert abs(taken[s] - want[s]) <= 2 * block * (shards + 1), s


def test_quotas_are_the_highest_quotients(spark):
    votes = [5300, 2400, 2300, 17, 0, 900]
    for seats in (0, 1, 5, 10, 97, 1000):
        rows = spark.createDataFrame([(0, i, v, seats, 10_000) for i, v in enumerate(votes)], "g int, p int, v long, s long, c long")
        got = {r["p"]: r["quota"] for r in mixing.apportion(rows, ["g"], ["p"], "v", "s", "c").collect()}
        want = Counter()
        for _ in range(seats):
            want[max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), votes[i]))] += 1
        assert got == {i: want[i] for i in range(len(votes))}, seats


def test_mixed_texts(docs, no_docs, by_id):
    columns = docs.columns
    out = mixing.apply_mix(docs.where("doc_id < 100"), block=8)
    assert out.columns == columns
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.where("doc_id < 100"), block=8).collect()}
    rows = {r["doc_id"]: r for r in out.collect()}
    source = {r[0]: r[1] for r in make_docs()}
    for i, n in taken.items():
        if n == 0:
            assert i not in rows
        else:
            words = _WORDS.findall(source[i])
            assert _WORDS.findall(rows[i]["text"]) == (words * 3)[:n] and rows[i]["n_chars"] == len(rows[i]["text"])
    clash = docs.where("doc_id < 100").withColumns({c: F.lit(c) for c in ("size", "taken", "record", "whole", "own_id", "mixed")})
    assert {tuple(r) for r in mixing.apply_mix(clash, block=8).collect()} == {
        (*r, "size", "taken", "record", "whole", "own_id", "mixed") for r in map(tuple, rows.values())}
    assert mixing.mix(no_docs).count() == 0 and mixing.apply_mix(no_docs).count() == 0


def test_digest_of_spans(spark, tmp_path):
    spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op3_pii(spark, str(tmp_path)).collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(PERSONAL[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) <= set(r["spans"].split(",")) | {""}
