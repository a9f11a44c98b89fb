"""Search, views, statistics, navigation and functions on small tables."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import Row, functions as F

from sparklog.functions import exceptions, levels, text, times
from sparklog.model import LEVELS
from sparklog.operators import navigate, stats, status, views
from sparklog.operators.numbering import dense_number
from sparklog.operators.search import search
from sparklog.sources.reader import read_logs

RECORD = ("source string, idx bigint, timestamp timestamp_ntz, level string, logger string, "
          "message string, exception string")


def records(spark, rows):
    """Rows of (idx, level, message, ...)."""
    full = [("s", r[0], None, r[1], *(list(r[3:4]) or ["L"]), r[2], *(list(r[4:5]) or [None]))
            for r in rows]
    return spark.createDataFrame(full, RECORD)


# ------------------------------------------------------------------ search

@pytest.fixture
def searched(spark):
    return records(spark, [
        (0, "Info", "Hello World", "a.b"), (1, None, "hello", "a.b"), (2, "Warn", None, "a.hello"),
        (3, "Error", "", "x", "say Hello"), (4, "Fatal", "a+b [x]", ""), (5, "Debug", "é1", "x")])


@pytest.mark.parametrize("query, options, want", [
    (None, {}, [0, 1, 2, 3, 4, 5]),
    ("", {}, [0, 1, 2, 3, 4, 5]),
    ("hello", {}, [0, 2, 3]),
    ("Hello", {"match_case": True}, [0, 3]),
    ("hello", {"levels": ["Info", "Error"]}, [0, 3]),
    ("", {"levels": ["Info", "Error"]}, [0, 3]),
    ("a+b [", {}, [4]),
    ("h.l+o$", {"regex": True}, [2, 3]),
    ("H.l+o", {"regex": True, "match_case": True}, [0, 3]),
    ("x*y*z*", {"regex": True}, [0, 2, 3, 4, 5]),
    (r"\bÉ\w", {"regex": True}, [5]),
])
def test_search(searched, query, options, want):
    got = search(searched, query, **options)
    assert [r.idx for r in got.orderBy("idx").collect()] == want


@pytest.mark.parametrize("options", [
    {"query": "a"}, {"query": "ab"}, {"levels": []}, {"levels": ["Loud"]}])
def test_search_refuses(searched, options):
    with pytest.raises(ValueError):
        search(searched, **options)


def test_search_reset_is_the_table(searched):
    assert search(searched, None, LEVELS) is searched


def test_search_reaches_the_scan(spark, searched, tmp_path):
    searched.write.parquet(str(tmp_path / "r"))
    written = spark.read.parquet(str(tmp_path / "r"))
    plan = search(written, "Hello", ["Warn"], match_case=True).select("idx") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(level), EqualTo(level,Warn)" in plan or \
        "In(level" in plan or "EqualTo(level,Warn)" in plan
    assert "timestamp" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_pandas_udf_predicate(searched):
    @F.pandas_udf("boolean")
    def odd(idx: pd.Series) -> pd.Series:
        return idx % 2 == 1
    assert searched.where(odd("idx")).count() == 3


# ------------------------------------------------------------------ views

def test_filtered_view_and_maps(spark):
    df = records(spark, [(3, "Info", "A"), (4, "Info", "B"), (5, "Info", "B")])
    view = views.filtered_view(df, F.col("message") == "B", bucket=1)
    assert [(r.local_idx, r.idx) for r in view.orderBy("idx").collect()] == [(0, 4), (1, 5)]
    asked = spark.createDataFrame([(0,), (7,)], "local_idx bigint")
    got = views.filtered_lookup(view, asked).orderBy("local_idx").collect()
    assert [(r.local_idx, r.idx, r.message) for r in got] == [(0, 4, "B"), (7, None, None)]
    back = views.local_index_of(view, spark.createDataFrame([(3,), (5,)], "idx bigint"))
    assert [tuple(r) for r in back.orderBy("idx").collect()] == [(3, -1), (5, 1)]


def test_dense_number_over_buckets(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), i) for i in rng.sample(range(5000), 700)]
    df = spark.createDataFrame(rows, "k string, idx bigint")
    want = {(k, i): n for k in "abc" for n, i in enumerate(sorted(i for x, i in rows if x == k))}
    for bucket in (1, 64, 10_000):
        got = dense_number(df, ["k"], "n", bucket=bucket).collect()
        assert {(r.k, r.idx): r.n for r in got} == want and len(got) == len(rows)


def test_lookups(spark):
    df = records(spark, [(0, "Info", "A"), (1, "Info", "B")])
    assert views.read_record(df, 1).first().message == "B"
    assert views.read_record(df, 9).count() == 0
    assert views.page_records(df, 5, 10).count() == 0
    assert views.record_detail(df, 1).first().asDict() == {
        "idx": 1, "message": "B", "exception": None}
    asked = spark.createDataFrame([(1,), (1,), (9,)], "idx bigint")
    assert sorted((r.idx, r.message or "") for r in views.batch_lookup(df, asked).collect()) == [
        (1, "B"), (1, "B"), (9, "")]


def test_zip_pairs_by_order(spark):
    schema = "source string, ordinal int, at int"
    starts = spark.createDataFrame([("s", 0, 1), ("s", 1, 5), ("s", 2, 9)], schema)
    ends = spark.createDataFrame([("s", 0, 3), ("s", 1, 7)], schema)
    assert sorted(tuple(r) for r in views.zip_starts_ends(starts, ends).collect()) == [
        ("s", 0, 1, 3), ("s", 1, 5, 7)]


def test_status(spark):
    segments = spark.createDataFrame([("s", 0, 0, 5), ("s", 1, 5, 6)],
                                     "source string, idx bigint, offset bigint, length bigint")
    sizes = spark.createDataFrame([("s", 50)], "source string, size bigint")
    assert tuple(status.source_status(segments, sizes).first()) == ("s", 2, True, 22)
    assert tuple(status.resume_offset(segments).first()) == ("s", 11)
    seen = status.record_status(segments, sizes).orderBy("idx").collect()
    assert [tuple(r.status) for r in seen] == [(1, True, 10), (2, True, 22)]
    df = spark.createDataFrame([("s", "A", 20), ("s", "B", 21), ("s", "B", 22)],
                               "source string, message string, progress int")
    assert tuple(status.filtered_status(df, F.col("message") == "B").first()) == ("s", 2, 22, True)


# ------------------------------------------------------------------ statistics and navigation

def one_per_level(spark):
    return records(spark, [(i + 1, level, "m") for i, level in enumerate(LEVELS)] + [(7, None, "m")])


def test_level_statistics(spark):
    df = one_per_level(spark)
    assert {r.level: r["count"] for r in stats.level_counts(df).collect()} == dict.fromkeys(LEVELS, 1)
    assert tuple(stats.level_counts_wide(df).first()) == (1, 1, 1, 1, 1, 1)
    assert {(r.level, r.pos, r.idx) for r in stats.level_index(df, bucket=2).collect()} == {
        (level, 0, i + 1) for i, level in enumerate(LEVELS)}
    assert stats.batch_level_counts(df, 4).count() == 6


@pytest.mark.parametrize("level, after, want", [
    ("Error", 0, [5]), ("Error", 5, []), ("Trace", -1, [1]), ("Info", 3, [])])
def test_next_record(spark, level, after, want):
    df = one_per_level(spark)
    assert [r.next_idx for r in navigate.next_record(df, level, after).collect()] == want


def test_next_record_reaches_zero(spark):
    assert navigate.next_record(records(spark, [(0, "Info", "m")]), "Info").first().next_idx == 0
    with pytest.raises(ValueError):
        navigate.next_record(records(spark, [(0, "Info", "m")]), "Loud")


def test_next_by_level_is_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([*LEVELS, None]), "m") for i in sorted(rng.sample(range(900), 150))]
    for bucket in (10, 100_000):
        for r in navigate.next_by_level(records(spark, rows), bucket=bucket).collect():
            for level in LEVELS:
                want = min((i for i, found, _ in rows if found == level and i > r.idx), default=None)
                assert r[f"next_{level.lower()}"] == want


def test_tail_and_last(spark):
    df = records(spark, [(i, "Info", str(i)) for i in range(10)])
    assert [r.idx for r in navigate.tail_n(df, 3).collect()] == [7, 8, 9]
    assert navigate.last_record(df).first().message == "9"


def test_debounce_over_buckets(spark):
    rng = random.Random(9)
    at, rows = datetime(2024, 1, 1), []
    for i in range(200):
        at += timedelta(milliseconds=rng.choice([1, 300, 700, 701, 5000]))
        rows.append(("s", i, at))
    want, last = [], None
    for _, i, t in rows:
        if last is not None and t - last <= timedelta(milliseconds=700):
            want[-1] = i
        else:
            want.append(i)
        last = t
    df = spark.createDataFrame(rows, "source string, idx bigint, timestamp timestamp_ntz")
    for bucket in (7, 1000):
        got = stats.debounced(df, "source", bucket=bucket).orderBy("idx").collect()
        assert [r.idx for r in got] == want


# ------------------------------------------------------------------ functions

def values(spark, column, *inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_levels(spark):
    assert values(spark, levels.parse_level, "TRACE", "warn", "Fatal", " Info", "x", None) == [
        "Trace", "Warn", "Fatal", None, None, None]
    assert values(spark, levels.level_ordinal, *LEVELS, None) == [0, 1, 2, 3, 4, 5, None]


def test_text(spark):
    assert values(spark, text.short_logger, "a.b.C", "C", "a.", "", None) == [
        "C", "C", "", None, None]
    assert values(spark, text.flatten_message, "a\r\nb\nc") == ["a \u200bb\nc"]
    assert values(spark, lambda c: text.restore_message(text.flatten_message(c)), "a\r\nb") == [
        "a\r\nb"]
    assert values(spark, text.base_name, r"c:\src\Cart.cs", "/a/b", "x", "") == [
        "Cart.cs", "b", "x", ""]
    assert values(spark, text.format_count, 0, 12, 1234567, kind="bigint") == [
        "", "12", "1,234,567"]
    assert values(spark, text.format_records, 0, 1234, kind="bigint") == ["0 records",
                                                                          "1,234 records"]
    assert values(spark, text.byte_length, "é") == [2]


def test_occurrences(spark):
    def find(lit, **kw):
        return lambda c: text.occurrences(c, lit, **kw)
    assert values(spark, find("aa"), "aaaa", "éaa", "", None, "b") == [
        [0, 1, 2], [2], [], None, []]
    assert values(spark, find("<log4j:event "), "<<log4j:event >") == [[1]]
    assert values(spark, find("aa", limit=2), "aaaa") == [[0, 1]]
    assert values(spark, lambda c: text.occurrence_count(c, "aa"), "aaaaa", "", None) == [2, 0, None]
    with pytest.raises(ValueError):
        text.occurrences(F.col("x"), "")


def test_times(spark):
    stamp = datetime(2012, 12, 31, 10, 0, 5)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert values(spark, times.parse_timestamp, "2012-12-31 10:00:05", "2012-12-31T10:00:05.0",
                      "nope", "") == [stamp, stamp, None, None]
        assert values(spark, lambda c: times.parse_timestamp(c, "dd.MM.yyyyTHH:mm:ss"),
                      "31.12.2012T10:00:05", "99.12.2012T10:00:05") == [stamp, None]
        # A wall time that the session's zone skips.
        assert values(spark, lambda c: times.parse_timestamp(c, "yyyy-MM-dd HH:mm"),
                      "2024-03-10 02:30") == [datetime(2024, 3, 10, 2, 30)]
        assert values(spark, times.epoch_millis, "500", "1500", "2500", "x", None) == [
            datetime(1970, 1, 1), datetime(1970, 1, 1, 0, 0, 2), datetime(1970, 1, 1, 0, 0, 2),
            None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert times.translate_pattern("dd.MM.yyyyTHH:mm:ss.fff tt") == "dd.MM.yyyy'T'HH:mm:ss.SSS a"
    assert values(spark, lambda c: text.format_timestamp(c, "short"), stamp,
                  kind="timestamp_ntz") == ["10:00:05"]


TRACE = ("System.InvalidOperationException: bad k\n"
         "   at Shop.Web.Cart.Add(Int32 k) in c:\\src\\Cart.cs:line 42\r\n"
         "   at Shop.Web.Cart.Run()\n"
         "free text")


def test_exception_lines(spark):
    df = spark.createDataFrame([(TRACE,), ("",), (None,)], "exception string")
    got = exceptions.exception_lines(df).orderBy("line_no").collect()
    assert [r.kind for r in got] == ["header", "frame", "frame", "other"]
    assert tuple(got[0].header) == ("System.", "InvalidOperationException", "bad k")
    assert tuple(got[1].frame) == ("Shop.Web.", "Cart", "Add", "Int32 k", "c:\\src\\Cart.cs",
                                   "Cart.cs", 42)
    assert tuple(got[2].frame) == ("Shop.Web.", "Cart", "Run", None, None, None, None)
    assert values(spark, lambda c: exceptions.render_frame(exceptions.stack_frame(c)),
                  "  at A.B.C[T].<M>(X x) in /s/f.cs:line 7", "   at A.B.Run()", "text") == [
        "   at A.B.C[T].<M>(X x) in f.cs:line 7", "   at A.B.Run()", None]


def test_null_keys_are_groups(spark):
    rows = [(None, i, datetime(2024, 1, 1, 0, 0, i), "Error") for i in range(3)] + [("s", 0, datetime(2024, 1, 1), "Error")]
    df = spark.createDataFrame(rows, "source string, idx long, timestamp timestamp_ntz, level string")
    assert stats.debounced(df, "source", bucket=2).count() == 4
    assert views.filtered_view(df, bucket=2).count() == 4
    assert navigate.next_by_level(df, bucket=2).count() == 4


def test_preview_keeps_the_order_of_lines(spark, tmp_path):
    for i in range(120):
        (tmp_path / f"{i}.log").write_text("".join(f"{i}-{n}\n" for n in range(30)))
    got = views.preview_lines(spark, str(tmp_path), 20).collect()
    assert len(got) == 2400
    assert all(r["line"].split("-")[1] == str(r["line_no"]) for r in got)


def test_routing_of_names_with_pattern_characters(spark, tmp_path):
    for name in ("a[1].log", "a1.log", "{b}.log", "c*.log", "d?.log", "e%20 f.log"):
        (tmp_path / name).write_text(f"line of {name}\n")
    (tmp_path / "z[2].log").write_text("level;message\ninfo;line of z\n")
    got = sorted(r["message"] for r in read_logs(spark, str(tmp_path)).collect())
    assert got == sorted([f"line of {n}" for n in ("a[1].log", "a1.log", "{b}.log", "c*.log", "d?.log", "e%20 f.log")] + ["line of z"])


def test_preview_of_long_records_and_lists_of_pairs(spark, tmp_path):
    (tmp_path / "a.log").write_text("level;message\n" + "".join(f'info;"{i}\n{"x" * 20}{chr(10) * 300}"\n' for i in range(7)))
    (tmp_path / "b.log").write_text("level;message\nwarn;only\n")
    shown = views.preview_files(spark, str(tmp_path), "csv", n=5, lines=4)
    got = [(r["source"][-5:], r["idx"], len(r["report"])) for r in shown.orderBy("source", "idx").collect()]
    assert [g[:2] for g in got] == [("a.log", i) for i in range(5)] + [("b.log", 0)] and min(n for _, _, n in got[:5]) > 320
    df = spark.createDataFrame([("a", [1, 5, 9], [2, 6]), ("b", [], [3]), ("c", None, [3])], "source string, s array<int>, e array<int>")
    assert [tuple(r) for r in views.zip_lists(df, F.col("s"), F.col("e")).orderBy("source", "ordinal").collect()] == [("a", 0, 1, 2), ("a", 1, 5, 6)]


def test_next_of_cursors_equals_a_search(spark):
    rng = random.Random(12)
    rows = [(s, i, rng.choice([None, "Error", "Info", "Fatal"])) for s in ("a", "b", None) for i in range(0, 60, rng.choice([1, 2]))]
    asked = [(s, n, f"c{k}") for k in range(3) for s in ("a", "b", None, "unknown") for n in (-9, -1, 0, 7, 7, 30, 58, 59, 60, 10 ** 12, None)]
    df = spark.createDataFrame(rows, "source string, idx long, level string").repartition(3)
    cursors = spark.createDataFrame(asked, "source string, after long, name string")
    for bucket in (4, 1000):
        got = navigate.next_of_cursors(df, cursors, bucket)
        assert got.columns[:3] == ["source", "after", "name"]
        found = sorted(map(str, got.select("source", "after", "name", "next_error", "next_info", "next_fatal", "next_warn").collect()))

        def first(s, n, level):
            return min((i for t, i, x in rows if n is not None and t == s and i > n and x == level), default=None)
        want = [spark_row(s, n, c, *[first(s, n, x) for x in ("Error", "Info", "Fatal", "Warn")]) for s, n, c in asked]
        assert found == sorted(want)
    none = navigate.next_of_cursors(df.where("false"), cursors)
    assert none.where("next_error is not null").count() == 0 and none.count() == len(asked)


def spark_row(source, after, name, *found):
    return str(Row(source=source, after=after, name=name, next_error=found[0], next_info=found[1], next_fatal=found[2], next_warn=found[3]))
