"""Fixtures of each format, and decisions on odd input."""

import gzip
import random
from datetime import datetime

import brute
import pytest
from pyspark.sql import functions as F

from sparklog.formats import csv, log4j, rules
from sparklog.formats.csv import CsvLayout
from sparklog.formats.registry import LogFormat, register_format
from sparklog.formats.rules import FieldRule, RuleSet
from sparklog.operators.detect import detect_format
from sparklog.sources.files import read_heads
from sparklog.sources.reader import from_payloads, read_logs

STAMP = r"\d{4}/\d\d/\d\d-\d\d:\d\d"


def event(level="DEBUG", ms="1402909876543", message="tide at 4 m", more=""):
    """An event with its tags on lines of their own, and as many properties as asked for."""
    return (f'<log4j:event timestamp="{ms}" thread="pier-2" level="{level}" logger="tide.gauge">\n'
            f"<log4j:message>{message}</log4j:message>\n"
            f'<log4j:properties><log4j:data name="gauge" value="north"/>{more}</log4j:properties>\n</log4j:event>')


# ------------------------------------------------------------------ csv

def test_csv_without_header(spark, write_file, rows):
    text = "fatal|7|left|mast|extra\nError|8|\"over | board\"|sail\n|9||keel"
    df = csv.read_csv(spark, write_file(text), CsvLayout(4, "|", level=0, logger=2, message=3, attributes={"watch": 1}))
    want = brute.csv_records(text.encode(), header=False)[1:]
    assert rows(df, "idx", "offset", "length") == [r[:3] for r in want]
    assert rows(df, "level", "logger", "message", "timestamp", "exception", "attributes") == [
        ("Error", "over | board", "sail", None, "", {"watch": "8"}), (None, "", "keel", None, "", {"watch": "9"})]


@pytest.mark.parametrize("delimiter", [";", ","])
def test_csv_header_in_any_order(spark, delimiter):
    rng, names = random.Random(4), ["time", "level", "message", "logger", "exception", "ship", "Berth", "crew"]
    for _ in range(6):
        rng.shuffle(names)
        got = csv.header_layout(spark.createDataFrame([(delimiter.join(names),)], "header string")).first()
        assert (got.delimiter, got.n_fields) == (delimiter, 8)
        assert [got.timestamp_at, got.level_at, got.message_at, got.logger_at, got.exception_at] == [
            names.index(n) for n in ("time", "level", "message", "logger", "exception")]
        assert [(a.name, a.position) for a in got.attributes] == [
            (n, i) for i, n in enumerate(names) if n in ("ship", "Berth", "crew")]


def test_csv_quoted_fields_over_lines(spark, write_file, rows):
    rng = random.Random(11)
    said = ["".join(rng.choice(["sea", " ", "\n", "\r\n", ";", "\n\n", "é"]) for _ in range(9)) for _ in range(30)]
    text = "ship;message;level;time\n" + "".join(
        f'{i};"{m}";{rng.choice(["warn", "fatal"])};2017-12-{1 + i % 28:02} 10:20:30{rng.choice([chr(10), chr(13) + chr(10)])}' for i, m in enumerate(said))
    df = csv.read_csv(spark, write_file(text))
    assert rows(df, "idx", "offset", "length") == [r[:3] for r in brute.csv_records(text.encode())]
    assert rows(df, "message", "timestamp", "attributes") == [
        (m, datetime(2017, 12, 1 + i % 28, 10, 20, 30), {"ship": str(i)}) for i, m in enumerate(said)]


def test_csv_odd_input(spark, write_file, rows):
    text = ("Time;LEVEL;message;ip;message;exception\n"
            '2012-01-01 01:39:40.25;Notice;x;1.2.3.4;a""b;\n'
            "no time;info;x;;y\n"
            "no time;info;x;;y;z\n"
            '2012-01-01;fatal;x;"5;6";"q;\n')
    df = csv.read_csv(spark, write_file(text), on_malformed="keep")
    assert rows(df, "idx", "timestamp", "level", "message", "logger", "thread", "exception",
                "attributes", "malformed") == [
        (0, datetime(2012, 1, 1, 1, 39, 40, 250000), None, 'a""b', "", None, "",
         {"ip": "1.2.3.4"}, None),
        (1, None, "Info", "y", "", None, "", {"ip": ""}, "field count"),
        (2, None, "Info", "y", "", None, "z", {"ip": ""}, None)]
    stopped = csv.read_csv(spark, write_file(text), on_malformed="stop")
    assert rows(stopped, "idx") == [(0,)]
    dropped = csv.read_csv(spark, write_file(text))
    assert rows(dropped, "idx") == [(0,), (2,)]
    with pytest.raises(ValueError):
        csv.read_csv(spark, write_file(text), on_malformed="ignore")


def test_csv_stop_beyond_broadcast(spark, write_file, rows, monkeypatch):
    from sparklog import scratch
    path = write_file("level;message\nInfo;a\nInfo;b\nbad\nInfo;c\n")
    monkeypatch.setattr(scratch, "MAX_BROADCAST_ROWS", 0)
    assert rows(csv.read_csv(spark, path, on_malformed="stop"), "idx") == [(0,), (1,)]


def test_csv_single_column_other_quote_and_delimiter(spark, write_file, rows):
    df = csv.read_csv(spark, write_file("message\na\nb"))
    assert rows(df, "idx", "offset", "length", "message") == [(0, 8, 2, "a"), (1, 10, 1, "b")]
    df = csv.read_csv(spark, write_file("level|message\ninfo|'a|\nb'\n"), delimiter="|", quote="'")
    assert rows(df, "level", "message") == [("Info", "a|\nb")]


def test_csv_several_headers(spark, tmp_path, write_file, rows):
    write_file("level;message\ninfo;a\n", "d/1.log")
    write_file("message,level\nb,warn\n", "d/2.log")
    df = csv.read_csv(spark, str(tmp_path / "d"))
    assert rows(df, "idx", "level", "message") == [(0, "Info", "a"), (0, "Warn", "b")]


def test_split_fields(spark):
    cases = {
        "a;b": ["a", "b"], ";": ["", ""], "": [""], '"a;b";c': ["a;b", "c"], 'a;"b;c': ["a"],
        '"a""b";': ['a""b', ""], 'x"y;z"w;v': ['x"y;z"w', "v"], '"a\r\nb";c': ["a\r\nb", "c"]}
    df = spark.createDataFrame([(k,) for k in cases], "r string")
    got = {r[0]: r[1] for r in df.select("r", csv.split_fields(F.col("r"), ";")).collect()}
    assert got == cases


def test_long_quoted_row(spark, write_file):
    long = '"' + 'x;""' * 200_000 + '"'
    df = csv.read_csv(spark, write_file(f"level;message\ninfo;{long}\n"))
    assert df.select(F.length("message")).first()[0] == 800_000


# ------------------------------------------------------------------ log4j

def test_log4j_events_with_and_without_properties(spark, write_file, rows):
    bare = '<log4j:event level="WARN" timestamp="1402909876600"><log4j:message>é</log4j:message></log4j:event>'
    text = event() + " \n" + bare + bare + event(message="") + "\n" + event(more='<log4j:data name="x" value=""/>')
    df = log4j.read_log4j(spark, write_file(text), attributes=True)
    assert rows(df, "idx", "offset", "length", "raw") == brute.log4j_segments(text.encode())
    assert rows(df, "level", "logger", "thread", "message", "attributes") == [
        ("Debug", "tide.gauge", "pier-2", "tide at 4 m", {"gauge": "north"}), *[("Warn", None, None, "é", None)] * 2,
        ("Debug", "tide.gauge", "pier-2", "", {"gauge": "north"}),
        ("Debug", "tide.gauge", "pier-2", "tide at 4 m", {"gauge": "north", "x": ""})]


def test_log4j_exception_and_time(spark, write_file, rows):
    path = write_file(event(ms="1402909876543", more='<log4j:data value="Flood&#10; at dock" name="exception"/>'))
    assert rows(log4j.read_log4j(spark, path), "timestamp", "exception") == [
        (datetime(2014, 6, 16, 9, 11, 17), "Flood\n at dock")]
    assert log4j.read_log4j(spark, path, precision="ms").first().timestamp == datetime(2014, 6, 16, 9, 11, 16, 543000)


def test_log4j_events_of_all_lengths_over_splits(spark, write_file, split_bytes, rows):
    rng = random.Random(8)
    text = "".join(event(message="é" * rng.randrange(400)) + "\n" * rng.randrange(3) for _ in range(700))
    path = write_file(text)
    split_bytes(7_001)
    assert rows(log4j.read_log4j(spark, path), "idx", "offset", "length", "raw") == brute.log4j_segments(text.encode())


def test_log4j_odd_events(spark, write_file, rows):
    path = write_file(
        "junk" + event() + event(message="<oops") + "<" + event(message="a &lt; b\r\nc")
        + '<log4j:event logger="x" level="no"></log4j:event>' + event()[:100])
    df = log4j.read_log4j(spark, path)
    assert rows(df, "idx", "offset", "level", "message", "timestamp", "exception")[1:] == [
        (2, 4 + len(event() + event(message="<oops")) + 1, "Debug", "a < b\nc", datetime(2014, 6, 16, 9, 11, 17), None),
        (3, 4 + len(event() + event(message="<oops")) + 1 + len(event(message="a &lt; b\r\nc")), None, None, None, None)]
    kept = log4j.read_log4j(spark, path, on_malformed="keep")
    assert rows(kept, "idx", "malformed") == [(0, None), (1, "xml"), (2, None), (3, None)]
    assert log4j.read_log4j(spark, path, index=False).count() == 3


# ------------------------------------------------------------------ plain text and encodings

def test_plain(spark, write_file, rows):
    text = "\n\r\nahoy\n\n\nland é\r\n  \r\nlast"
    df = read_logs(spark, write_file(text), "plain")
    assert rows(df, "idx", "offset", "length", "message") == brute.plain_records(text.encode())
    marked = read_logs(spark, write_file(b"\xef\xbb\xbfa\nb\xff"), "plain")
    assert rows(marked, "idx", "offset", "length", "message") == [
        (0, 3, 2, "a"), (1, 5, 2, "b�")]


def test_encodings_and_compression(spark, write_file, rows):
    path = write_file("é\nü\n".encode("latin-1"))
    df = read_logs(spark, path, "plain", encoding="ISO-8859-1")
    assert rows(df, "offset", "message") == [(0, "é"), (2, "ü")]
    packed = write_file(gzip.compress(b"level;message\ninfo;a\ninfo;b"), "b.log.gz")
    assert rows(csv.read_csv(spark, packed), "idx", "message") == [(0, "a"), (1, "b")]


# ------------------------------------------------------------------ rules

RULES = RuleSet(
    "deck log", start=STAMP + " +<", end=r">\n", timestamp_format="yyyy/MM/dd-HH:mm", fields=(
        FieldRule("timestamp", STAMP, state_from="INITIAL", state_to="T"),
        FieldRule("thread", r"deck (\d)", 1, state_from="T", state_to="D"),
        FieldRule("level", "WARN|INFO", state_from="D", state_to="L"),
        FieldRule("message", r"(?s)\w.*", state_from="L", state_to="END")))


def test_rules(spark, write_file, rows):
    text = ("lost\n2019/11/07-08:15 <deck 3 INFO rope\n  and chain>\nbetween\n2019/11/07-08:16   <deck 4 WARN fog>\n"
            "2019/11/07-08:17 <deck 5 none")
    df = rules.read_rules(spark, write_file(text), RULES)
    assert rows(df, "idx", "offset", "length", "raw") == brute.rule_records(text.encode(), RULES.start, RULES.end)
    assert rows(df, "timestamp", "thread", "level", "message") == [
        (datetime(2019, 11, 7, 8, 15), "3", "Info", "rope\n  and chain"), (datetime(2019, 11, 7, 8, 16), "4", "Warn", "fog"),
        (datetime(2019, 11, 7, 8, 17), "5", None, None)]


@pytest.mark.parametrize("start", ["(?<=[a-z] ){0}", "(?={0})", "(?<![a-z] ){0}", "(?:^|(?<=;)){0}", "^(?={0})", "{0}(?=x)|(?<=x){0}"])
@pytest.mark.parametrize("end", [None, "(?=!)", r"\r?\n"])
def test_starts_that_look_around_at_any_split(spark, write_file, rows, split_bytes, start, end):
    start = start.format("#\\d")
    lines = ["#1x one", "sea #2 two!", "x#3x;#4 é #5", "none", "#6", "a #7;#8 #9!!", "", "end #1"]
    text = "".join(x + b for x, b in zip(lines, ["\n", "\r\n", "\n", "\n", "\r\n", "\n", "\n", ""]))
    path = write_file(text)
    split_bytes(5)
    df = rules.read_rules(spark, path, RuleSet("around", start, end, (FieldRule("message", r"(?s)#.*"),)))
    want = brute.rule_records(text.encode(), start, end)
    assert len(want) > 1 and rows(df, "idx", "offset", "length", "raw") == want


def test_marks_in_the_text_and_starts_with_line_breaks(spark, write_file, rows):
    text = "a\ufdd1\ufdd0\ufdd1b #1\ufdd0\ufdd0 #2\ufdd1\n"
    df = rules.read_rules(spark, write_file(text), RuleSet("marks", "(?<= )#"))
    assert rows(df, "idx", "offset", "length", "raw") == brute.rule_records(text.encode(), "(?<= )#", None)
    for start in ("BEGIN\\n--", "a\nb", r"x\R"):
        with pytest.raises(ValueError):
            RuleSet("broken", start)
    assert RuleSet("sets", r"[^\n]#|\\n")


def test_rules_step_by_step_equals_one_pattern(spark, monkeypatch):
    texts = [("2019/11/07-08:15 <deck 3 INFO Hello",), ("deck 1 INFO x 2019/11/07-08:15",), ("x",),
             ("2019/11/07-08:15",), ("WARN INFO a\nb",)]
    df = spark.createDataFrame(texts, "raw string")
    loose = RuleSet("loose", "x", fields=(FieldRule("level", "INFO|WARN|DEBUG"),
                                          FieldRule("timestamp", STAMP),
                                          FieldRule("message", "[a-z]+")))
    for ruleset in (RULES, loose):
        assert rules.single_pattern(ruleset)
        once = [r[0] for r in df.select(rules.extract_fields(F.col("raw"), ruleset)).collect()]
        with monkeypatch.context() as m:
            m.setattr(rules, "single_pattern", lambda r: None)
            steps = [r[0] for r in df.select(rules.extract_fields(F.col("raw"), ruleset)).collect()]
        assert once == steps


def fields_of(spark, ruleset, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    return [r[0] for r in df.select(rules.extract_fields(F.col("raw"), ruleset)).collect()]


def test_first_match_in_the_text_wins(spark):
    late = RuleSet("late", "x", fields=(FieldRule("message", r"(?s)\S.*", state_from="TEXT"),
                                        FieldRule("level", "[A-Z]+", state_from="INITIAL", state_to="TEXT")))
    got, = fields_of(spark, late, "INFO hello")
    assert (got.level, got.message) == ("INFO", "hello")
    fork = RuleSet("fork", "x", fields=(
        FieldRule("level", "ERROR", state_from="INITIAL", state_to="E"),
        FieldRule("level", "WARN", state_from="INITIAL", state_to="W"),
        FieldRule("exception", r"\S.*", state_from="E"), FieldRule("message", r"\S.*", state_from="W")))
    got, = fields_of(spark, fork, "WARN disk then ERROR boom")
    assert (got.level, got.message, got.exception) == ("WARN", "disk then ERROR boom", None)


def test_rule_in_two_states_and_back_to_the_first(spark):
    ruleset = RuleSet("cargo", "x", fields=(
        FieldRule("logger", r"ship=(\w+)", 1, state_from="INITIAL", state_to="SHIP"),
        FieldRule("thread", r"quay=(\w+)", 1, state_from=("INITIAL", "SHIP"), state_to="QUAY"),
        FieldRule("message", r"say:[^;]+", state_from=("SHIP", "QUAY"), state_to="INITIAL")))
    a, b, c = fields_of(spark, ruleset, "ship=Ada quay=4 say:one;", "quay=5 say:two; ship=Bea say:three;", "say:none")
    assert (a.logger, a.thread, a.message) == ("Ada", "4", "say:one")
    assert (b.logger, b.thread, b.message) == ("Bea", "5", "say:three")
    assert (c.logger, c.thread, c.message) == (None, None, None)
    many, = fields_of(spark, ruleset, "".join(f"ship=s{i} say:m{i};" for i in range(40)))
    assert (many.logger, many.message) == ("s39", "say:m39")
    assert RuleSet.from_json(ruleset.to_json()) == ruleset


def test_longest_match_then_first_rule(spark):
    ruleset = RuleSet("r", "x", fields=(FieldRule("level", "ab", state_from="INITIAL", state_to="X"),
                                        FieldRule("message", "abc", state_from="INITIAL", state_to="X"),
                                        FieldRule("thread", "xyz", state_from="INITIAL", state_to="X"),
                                        FieldRule("logger", "x.z", state_from="INITIAL", state_to="X")))
    a, b = fields_of(spark, ruleset, "abc", "xyz")
    assert (a.level, a.message, b.thread, b.logger) == (None, "abc", "xyz", None)


def test_several_records_on_a_line(spark, write_file, rows, split_bytes):
    closed = RuleSet("brackets", r"\[", end=r"\]", fields=(FieldRule("message", r"(?s)\w.*"),))
    text = "[a one][b two]\n[c three]\ntail [d\nfour] x [e"
    for split in (5, 1000):
        split_bytes(split)
        df = rules.read_rules(spark, write_file(text), closed)
        assert rows(df, "idx", "offset", "length", "message") == [
            (0, 0, 6, "a one"), (1, 7, 6, "b two"), (2, 15, 8, "c three"), (3, 30, 7, "d\nfour"), (4, 41, 2, "e")]
    split_bytes(1000)
    open_ = RuleSet("hashes", "#", fields=(FieldRule("message", r"(?s)\w.*"),))
    df = rules.read_rules(spark, write_file("#one\nmore #two#é three\nend\n", "b.log"), open_)
    assert rows(df, "offset", "length", "message") == [(0, 10, "one\nmore "), (10, 4, "two"), (14, 14, "three\nend")]


def test_payloads_of_several_records(spark):
    df = spark.createDataFrame([(b'info;a\r\nwarn;"b\r\nc"\r\n',), (b"error;d",), (b"",)], "value binary")
    got = from_payloads(df, "csv", CsvLayout(2, level=0, message=1)).select("level", "message").collect()
    assert sorted(map(tuple, got)) == [("Error", "d"), ("Info", "a"), ("Warn", "b\r\nc")]
    df = spark.createDataFrame([(b"lead <one>\n<two\nlines> <three>",)], "value binary")
    ruleset = RuleSet("angles", "<", end=">", fields=(FieldRule("message", r"(?s)\w.*"),))
    assert [r.message for r in from_payloads(df, "rules", ruleset).collect()] == ["one", "two\nlines", "three"]


def test_rules_branching_states(spark):
    ruleset = RuleSet("branches", "x", fields=(
        FieldRule("level", "E:", state_from="INITIAL", state_to="ERR"),
        FieldRule("exception", "[a-z]+", state_from="ERR"),
        FieldRule("message", "[a-z]+", state_from="INITIAL")))
    assert rules.single_pattern(ruleset) is None
    df = spark.createDataFrame([("E:boom",), ("hello",)], "raw string")
    got = [r[0] for r in df.select(rules.extract_fields(F.col("raw"), ruleset)).collect()]
    assert [(g.exception, g.message) for g in got] == [("boom", None), (None, "hello")]


def test_rule_definitions():
    ruleset = RuleSet("r", "{line}", definitions={"d": "[0-9]{2}", "line": "{d}-{d}"})
    assert ruleset.expand("{line}") == "(?:(?:[0-9]{2})-(?:[0-9]{2}))"
    assert RuleSet.from_json(RULES.to_json()) == RULES
    for bad in ({"start": "{none}"}, {"start": "{a}", "definitions": {"a": "{a}"}},
                {"start": "x", "fields": (FieldRule("nope", "x"),)}):
        with pytest.raises(ValueError):
            RuleSet("bad", **bad)


# ------------------------------------------------------------------ detection and routing

def test_detection(spark, tmp_path, write_file, rows):
    files = {"a csv.log": "\n\nTime;Level\r\n", "b.log": "x,message|y\n", "c.log": event(),
             "d.log": "plain words\n", "f.log": "level;" + event(),
             "g.log": "the level is;low\n"}
    for name, text in files.items():
        write_file(text, "d/" + name)
    got = detect_format(read_heads(spark, str(tmp_path / "d")))
    assert [tuple(r) for r in got.orderBy("source").select("format", "candidates").collect()] == [
        ("csv", ["csv"]), ("csv", ["csv"]), ("log4j", ["log4j"]), ("plain", []),
        ("csv", ["csv", "log4j"]), ("plain", [])]
    forced = detect_format(read_heads(spark, str(tmp_path / "d")), "log4j")
    assert {r.format for r in forced.collect()} == {"log4j"}


def test_mixed_folder(spark, tmp_path, write_file):
    write_file("level;message\ninfo;a\n", "d/1 %.log")
    write_file(event(), "d/2.log")
    write_file("plain\n", "d/3.log")
    df = read_logs(spark, str(tmp_path / "d"))
    assert sorted((r.level or "", r.message) for r in df.collect()) == [
        ("", "plain"), ("Debug", "tide at 4 m"), ("Info", "a")]
    with pytest.raises(ValueError):
        read_logs(spark, str(tmp_path), quote="'")
    with pytest.raises(ValueError):
        read_logs(spark, str(tmp_path), "no such format")


def test_own_format(spark, write_file):
    def read(spark, path):
        return read_logs(spark, path, "plain").withColumn("level", F.lit("Info"))

    register_format(LogFormat("shout", read, read, lambda t: F.array(t),
                              lambda head: F.startswith(head, F.lit("SHOUT"))))
    try:
        assert read_logs(spark, write_file("SHOUT a\n")).first().level == "Info"
    finally:
        from sparklog.formats import registry
        del registry._FORMATS["shout"]


def test_payloads(spark):
    df = spark.createDataFrame(
        [(1, bytearray(b"info;a\r\n")), (2, bytearray(b"")), (3, bytearray(b'warn;"b\nc"'))],
        "n int, value binary")
    got = from_payloads(df, "csv", CsvLayout(2, level=0, message=1))
    assert sorted((r.origin.n, r.level, r.message) for r in got.collect()) == [
        (1, "Info", "a"), (3, "Warn", "b\nc")]
    events = spark.createDataFrame([(event() + event("WARN"),)], "value string")
    assert [r.level for r in from_payloads(events, "log4j").collect()] == ["Debug", "Warn"]
    lines = spark.createDataFrame([("a\r\n\nb",)], "value string")
    assert [r.message for r in from_payloads(lines, "plain").collect()] == ["a", "b"]


# ------------------------------------------------------------------ previews

def test_head_reads_the_beginning_only(spark, write_file, rows):
    from sparklog.operators import views
    path = write_file("level;message\r\ninfo;a\r\n" + 'warn;"b\n\nb"\r\n' * 5000)
    assert [r.line for r in views.preview_lines(spark, path, 3).orderBy("line_no").collect()] == [
        "level;message", "info;a", 'warn;"b']
    df = csv.read_csv(spark, path, head=100)
    assert rows(df, "idx", "offset", "length", "level")[:2] == [
        (0, 15, 8, "Info"), (1, 23, 13, "Warn")]
    assert df.count() == 33
    reports = views.preview_records(df, 2).orderBy("idx").collect()
    assert [r.report for r in reports] == [
        "Record #1\n  Level:     Info\n  Message:   a",
        "Record #2\n  Level:     Warn\n  Message:   b\n\nb"]
    short = write_file("a\nb")
    assert rows(read_logs(spark, short, "plain", head=9), "offset", "length") == [(0, 2), (2, 1)]
    assert log4j.read_log4j(spark, write_file(event() * 3), head=2).count() == 2
