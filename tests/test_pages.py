"""Chosen records are read by their bytes, and no other bytes are."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from sparklog.formats import csv, log4j, plain
from sparklog.formats.csv import CsvLayout
from sparklog.operators import views
from sparklog.sources import pages
from sparklog.sources.files import scan_units


@pytest.fixture
def indexed(spark, tmp_path):
    """Twenty files of plain lines, their segments, and an index with pages of 16 records."""
    rng = random.Random(3)
    (tmp_path / "logs").mkdir()
    for n in range(20):
        lines = [f"{n} " + "é" * rng.randrange(30) for _ in range(rng.randrange(1, 150))]
        (tmp_path / "logs" / f"a {n}.log").write_bytes((rng.choice(["\n", "\r\n"])).join(lines).encode() + b"\n" * rng.randrange(2))
    segments = plain.plain_segments(scan_units(spark, str(tmp_path / "logs"))).persist()
    pages.write_page_index(segments, str(tmp_path / "index"), page=16)
    yield segments, str(tmp_path / "index")
    segments.unpersist()


def read(spark, index):
    return pages.read_pages(spark, index, page=16)


def in_order(df):
    return [tuple(r) for r in df.select("source", "idx", "offset", "length", "raw").orderBy("source", "idx").collect()]


def test_all_records_are_read_back(spark, indexed):
    segments, index = indexed
    assert in_order(read(spark, index)) == in_order(segments)


def test_conditions_give_what_a_scan_gives(spark, indexed):
    segments, index = indexed
    name = segments.where(F.col("source").contains("7.log")).first()["source"]
    for condition in ("idx = 0", "idx between 10 and 40", "idx in (3, 17, 18, 90, 100000)", "idx > 14 and idx < 17", "idx >= 5 and length > 20",
                      f"source = '{name}' and idx <= 20", f"source in ('{name}', 'none') and idx in (1, 2)", "source = 'none'", "idx < 0",
                      "idx = 3 and idx = 4", "source is not null and idx <=> 2", "source like '%1.log'", "idx = 5 or idx = 50"):
        assert in_order(read(spark, index).where(condition)) == in_order(segments.where(condition)), condition


def test_one_record_opens_one_range_of_one_file(spark, indexed, monkeypatch):
    segments, index = indexed
    row = segments.orderBy(F.desc("idx")).first()
    reader = pages.PageReader({"path": index, "page": 16})
    left = list(reader.pushFilters([pages.EqualTo(("source",), row["source"]), pages.EqualTo(("idx",), row["idx"]),
                                    pages.EqualTo(("raw",), "x")]))
    assert left == [pages.EqualTo(("raw",), "x")]
    opened, plain_read = [], pages.read_bytes
    monkeypatch.setattr(pages, "read_bytes", lambda *a: opened.append(a) or plain_read(*a))
    found = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert [(r["idx"], r["raw"]) for r in found] == [(row["idx"], row["raw"])]
    assert opened == [(row["source"], row["offset"], row["offset"] + row["length"])]


def test_the_plan_has_no_filter_left_on_source_and_number(spark, indexed):
    _, index = indexed
    plan = views.page_records(read(spark, index), 10, 5, "s")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "BatchScan" in plan


def test_quoted_records_and_events(spark, tmp_path):
    text = 'info;"a\r\nb"\r\n' * 40 + "warn;é"
    (tmp_path / "a.log").write_text(text, newline="")
    layout = CsvLayout(2, level=0, message=1)
    segments, _ = csv.csv_segments(scan_units(spark, str(tmp_path / "a.log")), header=False)
    pages.write_page_index(segments, str(tmp_path / "i"), page=7)
    got = csv.parse_csv(pages.read_pages(spark, str(tmp_path / "i"), page=7).where("idx >= 39"), layout)
    assert [(r.idx, r.level, r.message) for r in got.orderBy("idx").collect()] == [(39, "Info", "a\r\nb"), (40, "Warn", "é")]
    event = "<log4j:event level='info'><log4j:message>{}</log4j:message></log4j:event> \n"
    (tmp_path / "b.gz").write_bytes(gzip.compress("".join(event.format(i) for i in range(300)).encode()))
    pages.write_page_index(log4j.log4j_segments(scan_units(spark, str(tmp_path / "b.gz"), log4j.EVENT_END)), str(tmp_path / "j"))
    got = log4j.parse_log4j(pages.read_pages(spark, str(tmp_path / "j")).where("idx in (7, 299)"))
    assert sorted((r.idx, r.message) for r in got.collect()) == [(7, "7"), (299, "299")]


def test_a_file_that_has_shrunk_is_an_error(spark, indexed):
    segments, index = indexed
    name = segments.orderBy(F.desc("idx")).first()["source"].removeprefix("file://").removeprefix("file:").replace("%20", " ")
    with open(name, "r+b") as file:
        file.truncate(3)
    with pytest.raises(Exception, match="write the index again"):
        read(spark, index).collect()


def test_an_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "source string, idx long, offset long, length long")
    pages.write_page_index(none, str(tmp_path / "none"))
    assert pages.read_pages(spark, str(tmp_path / "none")).collect() == []
