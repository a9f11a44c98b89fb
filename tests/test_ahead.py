"""Starts of records that go on in the lines behind them, over file splits."""

import re

import pytest
from pyspark.sql import functions as F

from sparklog.formats.rules import RuleSet, read_rules, rule_segments
from sparklog.operators.ahead import with_lines_ahead
from sparklog.streaming.follow import follow_rules

TEXT = ("lost\nBEGIN\n--\none\nBEGIN\nno dash\n\nx BEGIN\n-- two\nBEGIN\n--\nBEGIN\r\n--\n--\n"
        "#a\n\n#b#c\n\nmore\n\nend BEGIN")


def whole_file(data: bytes, start: str):
    """Offsets and texts between the starts of a scan over the whole file; the break at the end of a text goes."""
    at = [m.start() for m in re.finditer(start.encode(), data, re.MULTILINE)]
    texts = [data[a:b] for a, b in zip(at, [*at[1:], len(data)])]
    return [(i, a, len(t), re.sub(rb"\r?\n?\Z", b"", t).decode()) for i, (a, t) in enumerate(zip(at, texts))]


@pytest.mark.parametrize("size, start, lines", [
    (5, r"BEGIN\n--", 2), (1 << 20, r"^BEGIN\r?\n--", 2), (5, r"#[a-z]\n\n", 3), (16, r"\n-", 2),
    (5, r"BEGIN(?=\n--\n(?:one|BEGIN))", 3)])
def test_equals_a_scan_of_the_whole_file(tmp_path, cut_units, rows, size, start, lines):
    (tmp_path / "a.log").write_bytes(TEXT.encode())
    segments = rule_segments(cut_units(tmp_path, size), RuleSet("r", start, start_lines=lines))
    assert rows(segments, "idx", "offset", "length", "raw") == whole_file(TEXT.encode(), start)


def test_end_behind_a_start_over_lines(spark, write_file, rows):
    path = write_file("BEGIN\n--\na;\nlost\nBEGIN\n--b;c\n")
    records = read_rules(spark, path, RuleSet("r", r"BEGIN\n--", end=";", start_lines=2))
    assert rows(records, "idx", "raw") == [(0, "BEGIN\n--\na"), (1, "BEGIN\n--b")]


@pytest.mark.parametrize("shuffled", [False, True])
def test_lines_ahead(spark, tmp_path, cut_units, monkeypatch, shuffled):
    if shuffled:
        monkeypatch.setattr("sparklog.operators.ahead.MAX_BROADCAST_BYTES", 0)
    lines = ["a", "", "ccccccc", "é", "", "", "f"]
    for name in ("1.log", "2.log"):
        (tmp_path / name).write_text("\n".join(lines))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = with_lines_ahead(cut_units(tmp_path, 4), 2).select("source", "value", "ahead").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(line, "\n".join(lines[i + 1:i + 3])) for i, line in enumerate(lines)]
    for name in ("1.log", "2.log"):
        mine = [(r.value, r.ahead) for r in got if r.source.endswith(name)]
        assert sorted(mine) == sorted(want) if shuffled else mine == want


def test_odd_input(spark):
    units = spark.createDataFrame([("s", 0, None), ("s", 0, "b")], "source string, block bigint, value string").coalesce(1)
    assert [tuple(r) for r in with_lines_ahead(units, 3).select("value", "ahead").collect()] == [("", "b"), ("b", "")]
    assert with_lines_ahead(units.where(F.lit(False)), 1).count() == 0


def test_what_is_refused():
    with pytest.raises(ValueError):
        RuleSet("r", r"a\nb")
    with pytest.raises(ValueError):
        RuleSet("r", r"(?<=a\n)b", start_lines=2)
    with pytest.raises(ValueError):
        RuleSet("r", "a", start_lines=0)
    with pytest.raises(ValueError):
        follow_rules(RuleSet("r", r"a\nb", start_lines=2))
