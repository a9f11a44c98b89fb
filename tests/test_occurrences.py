"""A literal in files is found wherever lines and splits end."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from sparklog.operators.occurrences import find_in_units, occurrences_in_files


def places(df):
    return sorted((r.source.rsplit("/", 1)[-1], r.offset) for r in df.collect())


def brute(data: bytes, literal: str):
    needle = literal.encode()
    return [i for i in range(len(data)) if data.startswith(needle, i)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    return {
        "mixed.log": "".join(rng.choice(["ab", "a", "\n", "\r\n", "é", "\n\n"]) for _ in range(40)).encode() + b"ab",
        "breaks.log": b"\n" * 20,
        "ended.log": b"aba\nab\r\nab\n",
        "marked.log": b"\xef\xbb\xbfab\n\nab\r\na",
        "empty.log": b"",
    }


@pytest.mark.parametrize("size, literal", [(7, "a"), (7, "\n\n\n"), (7, "ab\r\na"), (11, "é\na"), (1 << 20, "ab\n")])
def test_equals_search_of_whole_files(tmp_path, cut_units, texts, size, literal):
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    got = places(find_in_units(cut_units(tmp_path, size), literal))
    assert got == sorted((name, at) for name, data in texts.items() for at in brute(data, literal))


def test_literal_longer_than_several_splits(tmp_path, cut_units):
    data = b"x\n" + b"12345\n67\n890\n" * 4
    (tmp_path / "a.log").write_bytes(data)
    literal = data[2:28].decode()
    got = places(find_in_units(cut_units(tmp_path, 5), literal))
    assert got == [("a.log", at) for at in brute(data, literal)] and len(got) == 3


def test_small_arrow_batches(spark, tmp_path):
    data = b"".join(b"%d\n" % (i % 3) for i in range(50))
    (tmp_path / "a.log").write_bytes(data)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = places(occurrences_in_files(spark, str(tmp_path), "2\n0\n1\n2"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [("a.log", at) for at in brute(data, "2\n0\n1\n2")]


def test_compressed_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.log.gz", "wb") as f:
        f.write(b"one\ntwo\none\n")
    assert places(occurrences_in_files(spark, str(tmp_path), "e\n")) == [("a.log.gz", 2), ("a.log.gz", 10)]


def test_beyond_the_broadcast_bound(tmp_path, cut_units, monkeypatch):
    monkeypatch.setattr("sparklog.scratch.MAX_BROADCAST_ROWS", 0)
    data = b"ab\ncd\n" * 20
    (tmp_path / "a.log").write_bytes(data)
    found = find_in_units(cut_units(tmp_path, 9), "d\nab")
    assert places(found) == [("a.log", at) for at in brute(data, "d\nab")]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_odd_input(spark):
    units = spark.createDataFrame([("s", 0, 9, None), ("s", 0, 9, "ab"), ("s", 0, 9, None), ("t", 0, 3, "xy")],
                                  "source string, block bigint, size bigint, value string").coalesce(1)
    assert places(find_in_units(units, "ab\n")) == [("s", 1)]
    assert places(find_in_units(units.where(F.lit(False)), "ab\n")) == []
    with pytest.raises(ValueError):
        find_in_units(units, "")
