"""Records over file splits: equal to a plain scan, whatever the split size."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import brute
from sparklog import scratch
from sparklog.formats import csv, log4j, plain, rules
from sparklog.formats.rules import RuleSet
from sparklog.operators import blocks
from sparklog.sources.files import scan_units

SPLITS = (23, 160, 1 << 20)
RULESETS = (
    RuleSet("open", start="#[0-9]"),
    RuleSet("line", start="#[0-9]", end=r"\r?\n"),
    RuleSet("closed", start="#[0-9]", end="!"),
)


def random_csv(rng):
    cells = ["a", "", '"x"', '"p;q"', '"two\r\nlines"', '"\n"', 'b""c', "é", '"', '"l\n\no\nng"']
    rows = [";".join(rng.choice(cells) for _ in range(rng.randint(1, 3)))
            for _ in range(rng.randint(0, 25))]
    end = rng.choice(["\n", "\r\n"])
    return "time;message" + end + end.join(rows) + rng.choice(["", end])


def random_rules(rng):
    words = ["#1 a", "x#2", "more", "", "end!", "#3 b! c", "é", "!"]
    end = rng.choice(["\n", "\r\n"])
    return end.join(rng.choice(words) for _ in range(rng.randint(0, 40))) + rng.choice(["", end])


def random_xml(rng):
    parts = ["<log4j:event x='1'>m</log4j:event>", "<log4j:event >é\n</log4j:event>", "\n", "junk",
             "<log4j:event y='2'>cut", "</log4j:event>", "<<log4j:event >q</log4j:event>"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))


def write_all(tmp_path, make, n=12, seed=7):
    rng = random.Random(seed)
    files = {}
    for i in range(n):
        data = make(rng).encode()
        (tmp_path / f"{i}.log").write_bytes(data)
        files[f"{i}.log"] = data
    return files


def collected(segments):
    got = {}
    rows = segments.select("source", "idx", "offset", "length", "raw").collect()
    for source, *row in rows:
        got.setdefault(Path(source).name, []).append(tuple(row))
    return {name: sorted(rows) for name, rows in got.items()}


def expected(files, scan):
    return {name: rows for name, rows in ((n, scan(d)) for n, d in files.items()) if rows}


@pytest.mark.parametrize("split", SPLITS)
def test_csv_records(spark, tmp_path, split_bytes, split):
    files = write_all(tmp_path, random_csv)
    split_bytes(split)
    segments, _ = csv.csv_segments(scan_units(spark, str(tmp_path)))
    assert collected(segments) == expected(files, brute.csv_records)


@pytest.mark.parametrize("split", SPLITS)
@pytest.mark.parametrize("ruleset", RULESETS, ids=lambda r: r.name)
def test_rule_records(spark, tmp_path, split_bytes, split, ruleset):
    files = write_all(tmp_path, random_rules)
    split_bytes(split)
    got = collected(rules.rule_segments(scan_units(spark, str(tmp_path)), ruleset))
    assert got == expected(
        files, lambda d: brute.rule_records(d, ruleset.start, ruleset.end))


@pytest.mark.parametrize("split", SPLITS)
def test_plain_and_log4j_records(spark, tmp_path, split_bytes, split):
    files = write_all(tmp_path, random_rules)
    split_bytes(split)
    got = collected(plain.plain_segments(scan_units(spark, str(tmp_path))))
    assert got == expected(files, brute.plain_records)

    xml = tmp_path / "xml"
    xml.mkdir()
    files = write_all(xml, random_xml)
    got = collected(log4j.log4j_segments(scan_units(spark, str(xml), log4j.EVENT_END)))
    assert got == expected(files, brute.log4j_segments)


def test_small_batches_and_no_broadcast(spark, tmp_path, split_bytes, monkeypatch):
    files = write_all(tmp_path, random_csv, seed=11)
    split_bytes(50)
    monkeypatch.setattr(scratch, "MAX_BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    hints = []
    monkeypatch.setattr(blocks.F, "broadcast", lambda df: hints.append(df) or df)
    try:
        segments, _ = csv.csv_segments(scan_units(spark, str(tmp_path)))
        assert collected(segments) == expected(files, brute.csv_records)
        assert not hints
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_records_keep_their_text(spark, tmp_path, split_bytes):
    long = '"' + "x\n" * 3_000_000 + '"'
    data = f"level;message\nInfo;a\nInfo;{long}\nInfo;b\n".encode()
    (tmp_path / "a.log").write_bytes(data)
    for split in (1_000_000, 100_000_000):
        split_bytes(split)
        records = csv.read_csv(spark, str(tmp_path))
        assert [r[0] for r in records.orderBy("idx").select(F.length("message")).collect()] == [1, 6_000_000, 1]


def test_unfinished_records_are_not_gathered(spark, tmp_path, split_bytes):
    split_bytes(50)
    (tmp_path / "a.log").write_text('level;message\nInfo;a\nInfo;"' + "never closed\n" * 100)
    segments, _ = csv.csv_segments(scan_units(spark, str(tmp_path)))
    assert [r["raw"] for r in segments.collect()] == ["Info;a"]


@pytest.mark.parametrize("first, second", [(500, 900), (900, 500), (500, 100_000)])
def test_other_splits_are_an_error(spark, tmp_path, split_bytes, first, second):
    (tmp_path / "a.log").write_text("level;message\n" + "".join(f"Info;line {i}\n" for i in range(400)))
    for read in (csv.read_csv, plain.read_plain):
        split_bytes(first)
        records = read(spark, str(tmp_path))
        assert records.count() >= 400
        split_bytes(second)
        with pytest.raises(Exception, match="split in another way"):
            # Plans are made anew for each action.
            records.select("idx", "message").collect()


def test_text_is_not_shuffled(spark, write_file):
    path = write_file("level;message\nInfo;a\nWarn;b\n")
    plan = csv.read_csv(spark, path).where(F.col("level") == "Warn") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
