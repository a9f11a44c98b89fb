"""Followed files give the records of a batch read, however the text arrives."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from sparklog import scratch
from sparklog.formats import csv, log4j, plain, rules
from sparklog.formats.rules import FieldRule, RuleSet
from sparklog.operators import stats
from sparklog.sources.files import scan_units
from sparklog.sources.tail import Range, TailReader, tail_units
from sparklog.streaming import follow, live

LINES = RuleSet("lines", start="^#", end=r"\r?\n", fields=(FieldRule("message", "[a-z]+"),))
OPEN = RuleSet("open", start="^#", fields=(FieldRule("message", "[a-z]+"),))


def advance(spark, path, follower, out, **options):
    """One run over all that is new, as after a restart."""
    units = tail_units(spark, str(path), follower.separator, **options)
    query = (follow.write_records(units, follower, str(out))
             .option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start())
    query.awaitTermination()


COLUMNS = ("source", "idx", "offset", "length", "level", "message")


def table(df):
    return sorted((r.source.rsplit("/", 1)[-1], *list(r)[1:])
                  for r in df.select(*COLUMNS).collect())


CASES = {
    "csv": (follow.follow_csv, csv.read_csv,
            'level;message\r\ninfo;a\r\nwarn;"two\r\nlines;\r\n"\r\nbad\r\nerror;é\r\n'
            'fatal;"x\n\n\ny"\r\ninfo;end\r\n'),
    "log4j": (follow.follow_log4j, log4j.read_log4j,
              "junk<log4j:event level='info'><log4j:message>a</log4j:message></log4j:event>\n"
              "<log4j:event level='warn'>broken</log4j:oops></log4j:event>"
              "<log4j:event level='error'><log4j:message>c\n</log4j:message></log4j:event>"),
    "plain": (follow.follow_plain, plain.read_plain, "a\r\n\r\nb\nlong line é\n\nc\n"),
    "lines": (lambda: follow.follow_rules(LINES),
              lambda spark, path: rules.read_rules(spark, path, LINES),
              "lost\n#a\nnoise\n#b x\r\n#c\n\n#d\n"),
    "open": (lambda: follow.follow_rules(OPEN),
             lambda spark, path: rules.read_rules(spark, path, OPEN),
             "lost\n#a\nmore a\n#b\r\n\r\nx\n#c\n#last\n"),
}


@pytest.mark.parametrize("name", CASES)
def test_follow_equals_batch(spark, tmp_path, name):
    make, read, text = CASES[name]
    rng = random.Random(name)
    folder, out = tmp_path / "logs", tmp_path / "out"
    folder.mkdir()
    data = {"1.log": text.encode() * 2, "2.log": text.encode()}
    if name == "csv":
        data["1.log"] = text.encode() + text.encode().split(b"\n", 1)[1]
    left = dict(data)
    while any(left.values()):
        for file in left:
            n = rng.randint(20, 160)
            with open(folder / file, "ab") as f:
                f.write(left[file][:n])
            left[file] = left[file][n:]
        advance(spark, folder, make(), out, range_bytes=rng.choice([9, 1000]))
    want = table(read(spark, str(folder)))
    if name == "open":
        # The last record of a file could still go on.
        last = {s: max(r[1] for r in want if r[0] == s) for s in data}
        want = [r for r in want if r[1] < last[r[0]]]
    assert want and table(follow.read_written(spark, str(out))) == want


def test_repeated_batch_writes_the_same(spark, tmp_path):
    path, out = tmp_path / "a.log", tmp_path / "out"
    path.write_text('level;message\ninfo;a\nwarn;"open\n')
    advance(spark, path, follow.follow_csv(), out)
    path.write_text(path.read_text() + 'closed"\n')
    advance(spark, path, follow.follow_csv(), out)
    want = table(follow.read_written(spark, str(out)))
    assert [r[-1] for r in want] == ["a", "open\nclosed"]
    # Lose the commit of the second batch: it runs again over the state of the first.
    (out / "progress" / "commits" / "1").unlink()
    (out / "progress" / "commits" / ".1.crc").unlink(missing_ok=True)
    advance(spark, path, follow.follow_csv(), out)
    assert table(follow.read_written(spark, str(out))) == want


def test_replaced_file_begins_anew(spark, tmp_path):
    path, out = tmp_path / "a.log", tmp_path / "out"
    path.write_text("one\ntwo\nthree\n")
    advance(spark, path, follow.follow_plain(), out)
    path.write_text("new\n")
    advance(spark, path, follow.follow_plain(), out)
    assert [(r[1], r[5]) for r in table(follow.read_written(spark, str(out)))] == [
        (0, "new"), (0, "one"), (1, "two"), (2, "three")]


def test_long_open_record_keeps_its_text(spark, tmp_path):
    path, out = tmp_path / "a.log", tmp_path / "out"
    path.write_text('level;message\ninfo;"' + "x\n" * 40)
    advance(spark, path, follow.follow_csv(on_malformed="keep"), out)
    path.write_text(path.read_text() + 'y"\nwarn;b\n')
    advance(spark, path, follow.follow_csv(on_malformed="keep"), out)
    got = follow.read_written(spark, str(out)).orderBy("idx").collect()
    assert [(r.idx, r.offset, r.length, r.malformed, r.message) for r in got] == [
        (0, 14, 89, None, "x\n" * 40 + "y"), (1, 103, 7, None, "b")]


@pytest.mark.parametrize("separator", ["\n", "<end>"])
@pytest.mark.parametrize("chunk", [2, 1 << 20])
def test_tail_ranges_cover_everything(tmp_path, monkeypatch, separator, chunk):
    monkeypatch.setattr("sparklog.sources.tail._CHUNK", chunk)
    rng = random.Random(1)
    records = ["x" * rng.choice([0, 1, 5, 40]) for _ in range(60)]
    path = tmp_path / "a.log"
    path.write_text("".join(r + separator for r in records) + "incomplete")
    for range_bytes in (1, 3, 7, 50, 10_000):
        reader = TailReader({"path": str(path), "separator": separator,
                             "rangebytes": str(range_bytes)})
        reader.initialOffset()
        end = reader.latestOffset()
        assert end == {str(path): sum(len(r) + len(separator) for r in records)}
        got = [v for p in reader.partitions({}, end) for batch in reader.read(p)
               for v in batch.column("value").to_pylist()]
        assert got == records


def test_tail_cap(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("aa\nbb\n" + "c" * 50 + "\ndd\n")
    reader = TailReader({"path": str(path), "maxbytespertrigger": "7"})
    at, seen = reader.initialOffset(), []
    while True:
        end = reader.latestOffset()
        if end == at:
            break
        seen.append([v for p in reader.partitions(at, end) for b in reader.read(p)
                     for v in b.column("value").to_pylist()])
        at = end
    assert seen == [["aa", "bb"], ["c" * 50], ["dd"]]
    assert isinstance(reader.partitions({}, at)[0], Range)
    # A reader started anew is told the last offset by a call for its partitions.
    again = TailReader({"path": str(path), "maxbytespertrigger": "7"})
    assert again.partitions({str(path): 6}, {str(path): 6}) == []
    assert again.latestOffset() == {str(path): 57}


@pytest.mark.parametrize("separator", ["\n", "<end>"])
def test_tail_counts_records(tmp_path, monkeypatch, separator):
    monkeypatch.setattr("sparklog.sources.tail._CHUNK", 7)
    records = {"a": ["", "x" * 30, "<en", "y"] * 5, "b": ["z"] * 3, "c": []}
    for name, texts in records.items():
        (tmp_path / name).write_text("".join(t + separator for t in texts) + "open<e")
    reader = TailReader({"path": str(tmp_path), "separator": separator, "maxrecordspertrigger": "8"})
    at, seen = reader.initialOffset(), []
    while True:
        end = reader.latestOffset()
        batch = {}
        for part in reader.partitions(at, end):
            for rows in reader.read(part):
                batch.setdefault(part.path.rsplit("/", 1)[-1], []).extend(rows.column("value").to_pylist())
        if not batch:
            break
        seen.append(batch)
        at = end
    # What small files leave over goes to the large one.
    assert [sum(map(len, batch.values())) for batch in seen] == [8, 8, 7]
    assert {name: [v for batch in seen for v in batch.get(name, [])] for name in records} == records
    with pytest.raises(ValueError):
        TailReader({"path": str(tmp_path), "maxrecordspertrigger": "8", "maxbytespertrigger": "8"})


def test_record_bound_opens_few_of_many_files(tmp_path):
    files = [tmp_path / f"{i:02}.log" for i in range(40)]
    for i, path in enumerate(files):
        path.write_text("".join(f"{i}-{n}\n" for n in range(12)))
    make = lambda: TailReader({"path": str(tmp_path), "maxrecordspertrigger": "20", "opencostbytes": "1000"})
    reader, at, seen, tasks = make(), {}, [], []
    while True:
        end = reader.latestOffset()
        parts = reader.partitions(at, end)
        if not parts:
            break
        tasks.append(len(parts))
        seen.append([v for part in parts for rows in reader.read(part) for v in rows.column("value").to_pylist()])
        at = end
        if len(seen) == 7:
            # After a restart the files go on taking turns; a file that grew waits for its own.
            with open(files[0], "a") as f:
                f.write("0-12\n")
            reader = make()
            assert reader.partitions(at, at) == []
    assert reader.latestOffset() == at
    assert [len(b) for b in seen] == [20] * 24 + [1] and set(tasks) == {1}
    assert max(len({v.split("-")[0] for v in b}) for b in seen) <= 6
    assert sorted(v for b in seen for v in b) == sorted([f"{i}-{n}" for i in range(40) for n in range(12)] + ["0-12"])
    assert not any("0-12" in b for b in seen[:8])


def test_record_bound_lists_seldom_and_names_few_files(tmp_path, monkeypatch):
    monkeypatch.setattr("sparklog.sources.tail._LISTING_PAUSE", 1_000_000)
    for i in range(400):
        (tmp_path / f"{i:03}.log").write_text(f"{i}-0\n{i}-1\n")
    reader = TailReader({"path": str(tmp_path), "maxrecordspertrigger": "30", "opencostbytes": "1000"})
    listings, files = [], reader._files
    reader._files = lambda *place: listings.append(place) or files(*place)
    at, seen, sizes = {}, [], []
    while True:
        end = json.loads(json.dumps(reader.latestOffset()))
        batch = [v for part in reader.partitions(at, end) for rows in reader.read(part)
                 for v in rows.column("value").to_pylist()]
        if not batch:
            break
        seen.append(batch)
        sizes.append(len(json.dumps(end)))
        at = end
        if len(seen) == 10:
            # A file that goes before its turn doesn't end the stream.
            (tmp_path / "399.log").unlink()
    assert [len(b) for b in seen] == [30] * 26 + [18]
    assert sorted(v for b in seen for v in b) == sorted(f"{i}-{n}" for i in range(399) for n in range(2))
    # At the begin, for the last batch that isn't full, and to find nothing more.
    assert len(listings) == 3
    named = len(json.dumps({str(tmp_path / f"{i:03}.log"): 12 for i in range(400)}))
    assert max(sizes) < named * 2 // 3


@pytest.mark.parametrize("pause", [0, 1_000_000])
@pytest.mark.parametrize("seed", range(4))
def test_record_bound_with_files_that_change(tmp_path, monkeypatch, pause, seed):
    monkeypatch.setattr("sparklog.sources.tail._LISTING_PAUSE", pause)
    monkeypatch.setattr("sparklog.sources.tail._LEAST_MOVED", 3)
    monkeypatch.setattr("sparklog.sources.tail._LEAST_SHARE", 5)
    rng = random.Random(seed)
    written, got = {}, {}

    def write(name, n):
        path = tmp_path / name
        with open(path, "a") as f:
            for _ in range(n):
                written.setdefault(str(path), []).append(f"{name} {len(written.get(str(path), []))}")
                f.write(written[str(path)][-1] + "\n")

    make = lambda: TailReader({"path": str(tmp_path), "maxrecordspertrigger": "16", "opencostbytes": "1000"})
    for i in range(12):
        write(f"{i}", rng.randrange(30))
    reader, at, replaced = make(), {}, False
    for step in range(200):
        end = json.loads(json.dumps(reader.latestOffset()))
        batch = [(rows.column("source")[0].as_py()[len("file:"):], v) for part in reader.partitions(at, end)
                 for rows in reader.read(part) for v in rows.column("value").to_pylist()]
        left = sum(map(len, written.values())) - sum(map(len, got.values()))
        assert len(batch) <= 16 and (pause or len(batch) == min(16, left))
        for path, value in batch:
            got.setdefault(path, []).append(value)
        at = end
        if not batch:
            if step > 60:
                break
            # All is read: one file begins anew, shorter, and others grow or come.
            for i in range(3):
                write(f"{rng.randrange(15)}", rng.randrange(1, 30))
            path = rng.choice(sorted(got))
            if not replaced and len(got[path]) > 1 and got[path] == written[path]:
                replaced = True
                (tmp_path / path).write_text("new\n")
                written[path], got[path] = ["new"], []
        elif step < 60 and rng.random() < 0.3:
            write(f"{rng.randrange(15)}", rng.randrange(4))
        if rng.random() < 0.2:
            reader = make()
            assert reader.partitions(at, at) == []
    assert replaced and got == {path: values for path, values in written.items() if values}


def test_offset_that_names_every_file_goes_on(tmp_path):
    for name in "abc":
        (tmp_path / name).write_text("".join(f"{name}{n}\n" for n in range(4)))
    path = lambda name: str(tmp_path / name)
    old = {path("a"): 12, path("b"): 6, path("c"): 0, "": path("b")}
    reader = TailReader({"path": str(tmp_path), "maxrecordspertrigger": "5", "opencostbytes": "1000"})
    assert reader.partitions({path("a"): 12, path("b"): 0}, old)[0].end == 6
    end = reader.latestOffset()
    assert [v for part in reader.partitions(old, end) for rows in reader.read(part)
            for v in rows.column("value").to_pylist()] == ["b2", "c0", "c1", "c2", "c3"]
    (tmp_path / "c").unlink()
    last = reader.latestOffset()
    assert [r.path for part in reader.partitions(end, last) for r in getattr(part, "ranges", [part])] == [path("b")]


def test_batches_are_counted_beside_the_stream(spark):
    go, waiting = threading.Event(), []

    class Batch:
        def __init__(self, n):
            self.n = n

        def coalesce(self, _):
            return self

        def count(self):
            waiting.append(self.n)
            assert go.wait(60)
            if self.n < 0:
                raise ValueError("no count")
            return self.n

    counts = live.BatchCounts(3)
    for i in range(3):
        counts(Batch(i + 5), i)
    go.set()
    counts(Batch(9), 3)
    counts(Batch(7), 1)
    assert counts.result() == {0: 5, 1: 7, 2: 7, 3: 9} and sorted(waiting) == [5, 6, 7, 7, 9]
    counts(Batch(-1), 4)
    with pytest.raises(ValueError):
        counts.result()
    counts.close()


def test_local_progress_by_the_older_interface(spark, tmp_path):
    key = "spark.sql.streaming.checkpointFileManagerClass"
    with scratch.checkpoint_files(spark, str(tmp_path)):
        assert spark.conf.get(key).endswith(".FileSystemBasedCheckpointFileManager")
        (tmp_path / "logs").mkdir()
        (tmp_path / "logs" / "a.log").write_text("x\ny\n")
        query = (tail_units(spark, str(tmp_path / "logs"), max_records_per_trigger=1).writeStream
                 .foreachBatch(lambda batch, _: batch.count()).option("checkpointLocation", str(tmp_path / "progress"))
                 .trigger(processingTime="0 seconds").start())
    assert spark.conf.get(key, None) is None
    query.processAllAvailable()
    query.stop()
    assert sorted(p.name for p in (tmp_path / "progress" / "commits").glob("[0-9]*")) == ["0", "1"]
    spark.conf.set(key, "chosen")
    try:
        with scratch.checkpoint_files(spark, str(tmp_path)):
            assert spark.conf.get(key) == "chosen"
        assert spark.conf.get(key) == "chosen"
    finally:
        spark.conf.unset(key)


def test_small_files_share_tasks(tmp_path):
    for i in range(10):
        (tmp_path / f"{i}.log").write_text("x\n" * 10 * (i + 1))
    options = {"path": str(tmp_path), "rangebytes": "100"}
    alone, packed = TailReader(options), TailReader({**options, "opencostbytes": "50"})
    read = lambda r, p: [b.to_pylist() for b in r.read(p)]
    parts = packed.partitions({}, packed.latestOffset())
    singles = alone.partitions({}, alone.latestOffset())
    assert len(parts) < len(singles) == 15
    assert [b for p in parts for b in read(packed, p)] == [b for p in singles for b in read(alone, p)]


def test_byte_bound_of_a_new_query(spark, tmp_path):
    folder, sizes = tmp_path / "logs", []
    folder.mkdir()
    (folder / "a.log").write_text("".join(f"{i}\n" for i in range(10)))
    query = (tail_units(spark, str(folder), max_bytes_per_trigger=8).writeStream
             .foreachBatch(lambda batch, _: sizes.append(sorted(int(r.value) for r in batch.collect())))
             .option("checkpointLocation", str(tmp_path / "progress")).trigger(processingTime="0 seconds").start())
    query.processAllAvailable()
    query.stop()
    assert sizes == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]


def test_record_bound_holds_after_a_restart(spark, tmp_path):
    folder, sizes = tmp_path / "logs", []
    folder.mkdir()
    (folder / "a.log").write_text("".join(f"{i}\n" for i in range(25)))

    def run(once):
        query = (tail_units(spark, str(folder), max_records_per_trigger=10).writeStream
                 .foreachBatch(lambda batch, _: sizes.append(sorted(int(r.value) for r in batch.collect())))
                 .option("checkpointLocation", str(tmp_path / "progress")))
        if once:
            query.trigger(availableNow=True).start().awaitTermination()
        else:
            query = query.trigger(processingTime="0 seconds").start()
            query.processAllAvailable()
            query.stop()

    run(True)
    run(True)
    with open(folder / "a.log", "a") as f:
        f.write("".join(f"{i}\n" for i in range(25, 32)))
    run(False)
    assert sizes == [list(range(10)), list(range(10, 20)), list(range(20, 30)), [30, 31]]


def test_byte_order_mark(spark, tmp_path):
    path, out = tmp_path / "a.log", tmp_path / "out"
    path.write_bytes(b"\xef\xbb\xbflevel;message\ninfo;a\n")
    advance(spark, path, follow.follow_csv(), out)
    assert [r[1:] for r in table(follow.read_written(spark, str(out)))] == [
        (0, 17, 7, "Info", "a")]


def test_growing_filtered_view(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "source string, idx bigint, level string"
    for part in ([(0, "Error"), (1, "Info")], [(2, "Error"), (3, "Error")], [(4, "Info")]):
        spark.createDataFrame([("s", *p) for p in part], schema).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        query = (follow.write_filtered_view(stream, F.col("level") == "Error", out)
                 .option("checkpointLocation", out + "/progress").trigger(availableNow=True).start())
        query.awaitTermination()
    got = follow.read_written(spark, out, "view")
    assert sorted((r.idx, r.local_idx) for r in got.collect()) == [(0, 0), (2, 1), (3, 2)]


def test_live_results(spark, tmp_path):
    path = tmp_path / "a.log"
    counts, index, dump = (str(tmp_path / n) for n in ("counts", "index", "dump"))
    layout = csv.CsvLayout(2, level=0, message=1)

    def run(writer, out):
        writer.option("checkpointLocation", out + "-progress").trigger(
            availableNow=True).start().awaitTermination()

    for text in ("info;a\nwarn;b\n", "info;c\n"):
        with open(path, "a") as f:
            f.write(text)
        lines = tail_units(spark, str(path)).select("source", F.col("value").alias("raw"))
        records = csv.parse_csv(lines, layout)
        run(live.write_latest(live.running_level_counts(records), counts), counts)
        run(live.write_level_index(records.withColumn("idx", F.length("message").cast("bigint")),
                                   index), index)
        run(live.dump_payloads(tail_units(spark, str(path)).select("value"), dump), dump)
    assert {r.level: r["count"] for r in live.read_latest(spark, counts).collect()} == {
        "Info": 2, "Warn": 1}
    assert spark.read.parquet(index).where("level = 'Info'").count() == 2
    assert sorted(r.value for r in spark.read.text(dump).collect()) == ["info;a", "info;c", "warn;b"]
    units = scan_units(spark, dump)
    assert plain.plain_segments(units, index=False).count() == 3


def test_debounced_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate([0, 300, 2000, 2500, 9000])],
                               "source string, idx bigint, ms bigint")
    df = df.withColumn("timestamp", F.timestamp_millis("ms"))
    df.write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder).withWatermark("timestamp", "1 second")
    query = (stats.debounced_stream(stream, "source").writeStream.format("memory")
             .queryName("bursts").outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    assert sorted(r.idx for r in spark.table("bursts").collect()) == [1, 3]


def test_sampled_status_of_a_stream_drops_state_behind_the_watermark(spark, tmp_path):
    from datetime import datetime, timedelta
    begin = datetime(2020, 1, 1)
    schema = "timestamp timestamp, idx long"

    def sample(*rows):
        (spark.createDataFrame([(begin + timedelta(seconds=s), i) for s, i in rows], schema).coalesce(1)
         .write.mode("append").parquet(str(tmp_path / "in")))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        (stats.status_sampled_stream(stream, late="4 seconds").writeStream.format("parquet").outputMode("append")
         .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress"))
         .trigger(availableNow=True).start().awaitTermination())
        return sorted(((r.start - begin).seconds, r.idx) for r in spark.read.schema("start timestamp, idx long").parquet(
            str(tmp_path / "out")).collect())

    assert sample((0.1, 1), (1.9, 2), (2.5, 3), (7, 4)) == [(0, 2)]
    # 0.5 comes after its window was given out; 5 is late, but waited for.
    assert sample((0.5, 90), (5, 5), (12, 6)) == [(0, 2), (2, 3), (4, 5), (6, 4)]


def test_running_status_with_sizes(spark, tmp_path):
    schema = "source string, offset long, length long, size long"
    folder, out = tmp_path / "in", tmp_path / "out"
    for rows in ([("a", 0, 10, 40), ("b", 0, 5, 5)], [("a", 10, 20, 60)], [("a", 30, 30, 60)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(schema).parquet(str(folder))
        (live.write_latest(live.running_status(stream), str(out)).option("checkpointLocation", f"{out}/progress")
         .trigger(availableNow=True).start().awaitTermination())
        last = {r["source"]: tuple(r)[1:] for r in live.read_latest(spark, str(out)).collect()}
        if rows[0][2] == 20:
            assert last["a"] == (2, 30, True, 50)
    assert last == {"a": (3, 60, False, 100), "b": (1, 5, False, 100)}


def _folders(path):
    return sorted(p.name for p in path.iterdir() if p.is_dir())


def test_state_and_helper_tables_do_not_grow(spark, tmp_path):
    from pathlib import Path
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    path, out = tmp_path / "a.log", tmp_path / "out"
    path.write_text("level;message\n")
    advance(spark, path, follow.follow_csv(), out)
    before = _folders(shared)
    for i in range(3):
        path.write_text(path.read_text() + f'info;"{i}\nopen')
        advance(spark, path, follow.follow_csv(), out)
        path.write_text(path.read_text() + '"\n')
    advance(spark, path, follow.follow_csv(), out)
    assert [r[5] for r in table(follow.read_written(spark, str(out)))] == [f"{i}\nopen" for i in range(3)]
    assert len(_folders(out / "state")) == 2 and _folders(shared) == before


def test_a_kill_between_records_and_state_loses_nothing(spark, tmp_path, monkeypatch):
    path, out = tmp_path / "a.log", tmp_path / "out"
    for i in range(4):
        path.write_text("".join(f"line {k}\n" for k in range(3 * i + 3)))
        if i == 2:
            # The records of this micro-batch are written, its state is not.
            broken = follow.Follower("\n", lambda units, state: (follow.follow_plain().step(units, state)[0], state.selectExpr("raise_error('killed') as x")))
            with pytest.raises(Exception, match="killed"):
                advance(spark, path, broken, out)
        advance(spark, path, follow.follow_plain(), out)
    assert [(r[1], r[5]) for r in table(follow.read_written(spark, str(out)))] == [(k, f"line {k}") for k in range(12)]
    assert len(_folders(out / "state")) == 2


def test_only_the_last_results_stay(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    for i in range(5):
        spark.createDataFrame([("a", i * 10, 10)], "source string, offset long, length long").write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema("source string, offset long, length long").parquet(str(folder))
        (live.write_latest(live.running_status(stream), str(out)).option("checkpointLocation", f"{tmp_path}/progress")
         .trigger(availableNow=True).start().awaitTermination())
        assert [tuple(r) for r in live.read_latest(spark, str(out)).collect()] == [("a", i + 1, i * 10 + 10)]
    assert _folders(out) == ["batch_id=3", "batch_id=4", "done"] and _folders(out / "done") == ["batch_id=3", "batch_id=4"]
