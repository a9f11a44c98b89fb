"""Registered queries: each one runs an operator over whole tables, most with SQL beside it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..formats import csv as csv_format, log4j, plain, rules
from ..formats.csv import CsvLayout
from ..formats.scanner import scan_records
from ..functions import exceptions, levels, text, times
from ..model import LEVELS
from ..operators import detect, navigate, search as searching, stats, status, views
from ..operators.occurrences import occurrences_in_files
from ..scratch import checkpoint_files, new_path
from ..sources import pages
from ..sources.files import list_files, read_heads, scan_units
from ..sources.reader import from_payloads, read_logs
from ..sources.tail import tail_units
from ..streaming import follow, live, payloads
from . import bridge
from .bridge import LINE_RULES, RULES, file_src, log_files, log_records, table
from .oracle import CSV_TEXT, EVENT_TEXT, LR, PLAIN_TEXT, RULES_TEXT

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def _csv(spark, sf_dir, **kwargs):
    return read_logs(spark, log_files(spark, sf_dir, "csv"), "csv", **kwargs)


def _with_src(df: DataFrame, *columns) -> DataFrame:
    return df.select(file_src().alias("src"), *columns)


# ------------------------------------------------------------------ flagship

@query("error_counts", LR + """
select src, level, count(*) as count from lr
where level in ('Error', 'Fatal') and idx % 97 <> 96 group by src, level""")
def error_counts(spark, sf_dir):
    records = searching.search(_csv(spark, sf_dir), levels=("Error", "Fatal"))
    return stats.level_counts(records.withColumn("src", file_src()), "src")


# ------------------------------------------------------------------ scans and segments

@query("scan_text_lines", PLAIN_TEXT + "select src, line from placed")
def scan_text_lines(spark, sf_dir):
    units = scan_units(spark, log_files(spark, sf_dir, "plain"))
    return _with_src(units, F.regexp_replace("value", r"\r\z", "").alias("line"))


def _plain_segments(spark, sf_dir):
    return plain.plain_segments(scan_units(spark, log_files(spark, sf_dir, "plain")))


@query("segment_index", PLAIN_TEXT + 'select src, idx, "offset", length from plain')
def segment_index(spark, sf_dir):
    return _with_src(_plain_segments(spark, sf_dir), "idx", "offset", "length")


@query("record_index", RULES_TEXT + "select src, idx, message from ruled")
def record_index(spark, sf_dir):
    records = read_logs(spark, log_files(spark, sf_dir, "rules"), "rules", rules=RULES)
    return _with_src(records, "idx", "message")


@query("read_record", LR + "select src, idx, message, exception from lr where idx = 1234")
def read_record(spark, sf_dir):
    lr = log_records(spark, sf_dir)
    return views.read_record(lr, 1234).select("src", "idx", "message", "exception")


@query("record_detail", LR + """
select idx, message, exception from lr where idx = 77 and source = 'events-1'""")
def record_detail(spark, sf_dir):
    return views.record_detail(log_records(spark, sf_dir), 77, "events-1")


@query("page_records", LR + """
select src, idx, "timestamp", level, message from lr where idx between 200 and 249""")
def page_records(spark, sf_dir):
    return views.page_records(log_records(spark, sf_dir), 200, 50).select(
        "src", "idx", "timestamp", "level", "message")


def _paged(spark, sf_dir, kind, segments):
    """Segments of the rendered files of a kind, read through an index of their pages."""
    path = new_path(spark, f"pages-{kind}")
    pages.write_page_index(segments, path)
    return pages.read_pages(spark, path)


@query("ranged_record", EVENT_TEXT + """
select src, idx, "offset", length, event_time as "timestamp", level, message from (
  select *, cast(sum(strlen(raw)) over (partition by src order by idx) - strlen(raw) + idx as bigint) as "offset",
    cast(strlen(raw) as bigint) as length from xml) where idx = 1234 and idx % 101 <> 0""")
def ranged_record(spark, sf_dir):
    units = scan_units(spark, log_files(spark, sf_dir, "log4j"), log4j.EVENT_END)
    segments = _paged(spark, sf_dir, "log4j", log4j.log4j_segments(units))
    return _with_src(log4j.parse_log4j(views.read_record(segments, 1234)), "idx", "offset", "length", "timestamp", "level", "message")


@query("ranged_page", PLAIN_TEXT + """
select src, idx, "offset", length, line as message from plain where src = 1 and idx between 1000 and 1099""")
def ranged_page(spark, sf_dir):
    segments = _paged(spark, sf_dir, "plain", _plain_segments(spark, sf_dir))
    # The name of a source comes from the listing of files.
    file = list_files(spark, log_files(spark, sf_dir, "plain")).where(file_src() == 1).first()
    page = views.page_records(segments, 1000, 100, file["source"] if file else "none")
    return _with_src(plain.parse_plain(page), "idx", "offset", "length", "message")


@query("ranged_detail", RULES_TEXT + """
select idx, message, cast(null as varchar) as exception from ruled where idx in (77, 2048, 3999) and src = 0""")
def ranged_detail(spark, sf_dir):
    units = scan_units(spark, log_files(spark, sf_dir, "rules"))
    segments = _paged(spark, sf_dir, "rules", rules.rule_segments(units, RULES))
    chosen = segments.where(F.col("idx").isin(77, 2048, 3999)).where(file_src() == 0)
    return rules.parse_rules(chosen, RULES).select("idx", "message", "exception")


@query("batch_lookup", LR + """
, asked as (select 'events-' || (value_id % 3) as source, value_id * 37 as idx from (
    select o_custkey as value_id from orders where o_custkey is not null group by o_custkey))
select a.source, a.idx, lr.level, lr.message from asked a
left join lr on lr.source = a.source and lr.idx = a.idx""")
def batch_lookup(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").where("o_custkey is not null").select(
        "o_custkey").distinct().select(
        F.concat(F.lit("events-"), F.col("o_custkey") % 3).alias("source"),
        (F.col("o_custkey") * 37).alias("idx"))
    found = views.batch_lookup(log_records(spark, sf_dir), asked)
    return found.select("source", "idx", "level", "message")


def _sized(spark, sf_dir):
    return list_files(spark, log_files(spark, sf_dir, "plain"))


@query("source_status", PLAIN_TEXT + """
, size as (select src, sum(length) as size from placed group by src),
done as (select src, count(*) as n, max("offset" + length) as e from plain group by src)
select src, cast(n as bigint) as count, e < size as is_processing_saved_data,
  cast(100 * e // size as int) as progress from done join size using (src)""")
def source_status(spark, sf_dir):
    return _with_src(status.source_status(_plain_segments(spark, sf_dir), _sized(spark, sf_dir)),
                     "count", "is_processing_saved_data", "progress")


@query("record_status", PLAIN_TEXT + """
, size as (select src, sum(length) as size from placed group by src)
select src, idx, idx + 1 as count, "offset" + length < size as is_processing_saved_data,
  cast(100 * ("offset" + length) // size as int) as progress from plain join size using (src)""")
def record_status(spark, sf_dir):
    seen = status.record_status(_plain_segments(spark, sf_dir), _sized(spark, sf_dir))
    return _with_src(seen, "idx", "status.*")


@query("resume_offset", PLAIN_TEXT + """
select src, max("offset" + length) as resume_offset from plain group by src""")
def resume_offset(spark, sf_dir):
    return _with_src(status.resume_offset(_plain_segments(spark, sf_dir)), "resume_offset")


@query("preview_lines", PLAIN_TEXT + """
select src, line_no, line from (select src, line,
  cast(row_number() over (partition by src order by idx, pos) - 1 as int) as line_no from placed)
where line_no < 20""")
def preview_lines(spark, sf_dir):
    return _with_src(views.preview_lines(spark, log_files(spark, sf_dir, "plain")),
                     "line_no", "line")


@query("preview_records", CSV_TEXT + """
select src, idx, 'Record #' || (idx + 1)
  || chr(10) || '  Timestamp: ' || strftime("timestamp", '%Y-%m-%d %H:%M:%S')
  || coalesce(chr(10) || '  Level:     ' || level, '')
  || chr(10) || '  Logger:    ' || logger || chr(10) || '  Message:   ' || csv_message
  || case when csv_exception <> '' then chr(10) || '  Exception: ' || csv_exception else '' end
  as report from csv where idx < 5""")
def preview_records(spark, sf_dir):
    return _with_src(views.preview_files(spark, log_files(spark, sf_dir, "csv"), "csv"), "idx", "report")


@query("payload_records", EVENT_TEXT + """
select src, idx, level, logger, thread, event_time as "timestamp", message, exception
from xml where idx % 101 <> 0
union all
select src, idx, level, logger, thread, event_time, message, exception
from xml where idx % 101 <> 0 and idx % 5 = 0""")
def payload_records(spark, sf_dir):
    events = bridge.log4j_event(log_records(spark, sf_dir))
    twice = F.when(F.col("idx") % 5 == 0, F.concat("event", "event")).otherwise(F.col("event"))
    value = F.when(F.col("idx") % 101 == 0, F.lit("")).otherwise(twice)
    payloads = events.select("src", "idx", F.encode(value, "UTF-8").alias("value"))
    return from_payloads(payloads, "log4j").select(
        "origin.*", "level", "logger", "thread", "timestamp", "message", "exception")


_REPEATED = """select event_id as idx, n, event_type || ' ' || n as said
from events, unnest(range(event_id % 3 + 1)) as t(n)"""


def _repeated_events(spark, sf_dir, record, between):
    """One payload per event with one to three records; ``record`` is a text for the number n."""
    records = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("event_id") % 3), record)
    text = F.array_join(records, between)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("idx"), F.encode(text, "UTF-8").alias("value"))


@query("payload_csv_multi", f"""
select idx, 'Info' as level, said || chr(10) || '; end' as message from ({_REPEATED})""")
def payload_csv_multi(spark, sf_dir):
    payloads = _repeated_events(spark, sf_dir, lambda n: F.concat(
        F.lit('info;"'), "event_type", F.lit(" "), n.cast("string"), F.lit('\n; end"')), "\r\n")
    layout = CsvLayout(2, level=0, message=1)
    return from_payloads(payloads, "csv", layout).select("origin.idx", "level", "message")


@query("payload_rules_multi", f"""
select idx, case when n = 1 then 'Error' else 'Warn' end as level,
  case when n = 1 then null else said end as message,
  case when n = 1 then said end as exception from ({_REPEATED})""")
def payload_rules_multi(spark, sf_dir):
    rules_of = rules.RuleSet("marks", "<", end=">", fields=(
        rules.FieldRule("message", r"\w.*", state_from="W"), rules.FieldRule("exception", r"\w.*", state_from="E"),
        rules.FieldRule("level", "WARN", state_from="INITIAL", state_to="W"),
        rules.FieldRule("level", "ERROR", state_from="INITIAL", state_to="E")))
    payloads = _repeated_events(spark, sf_dir, lambda n: F.concat(
        F.lit("<"), F.when(n == 1, "ERROR ").otherwise("WARN "), F.col("event_type"), F.lit(" "), n.cast("string"), F.lit(">")), "")
    return from_payloads(payloads, "rules", rules_of).select(
        "origin.idx", "level", "message", "exception")


def _framed(spark, stream, name, **options):
    out = new_path(spark, f"framed-{name}")
    chunks = payloads.frame_payloads(stream, ["origin"], ["at", "part"], between="", **options)
    _finish(payloads.write_payload_records(chunks, out), out)
    return follow.read_written(spark, out)


@query("payload_split", EVENT_TEXT + """
select source as origin, level, logger, thread, event_time as "timestamp", message, exception
from xml where idx % 101 <> 0""")
def payload_split(spark, sf_dir):
    events = bridge.log4j_event(log_records(spark, sf_dir)).where("idx % 101 <> 0")
    texts = events.select(F.col("source").alias("origin"), F.col("idx").alias("at"), F.col("event").alias("text"))
    stream = bridge.payload_stream(spark, sf_dir, texts, "split")
    return _framed(spark, stream, "split", format="log4j").select(
        "origin.origin", "level", "logger", "thread", "timestamp", "message", "exception")


@query("payload_auto", EVENT_TEXT + """
select 'log4j' as kind, src, level, message from xml where idx % 101 <> 0
union all select 'csv', src, level, replace(message, '"', '""') from lr where idx % 97 <> 96
union all select 'plain', src, null, unnest(string_split(message, crlf))
from (select src, message, chr(13) || chr(10) as crlf from lr)""")
def payload_auto(spark, sf_dir):
    lr = log_records(spark, sf_dir)
    origin = lambda kind: F.concat(F.lit(f"{kind}-"), "src").alias("origin")
    csv_texts = lr.select(origin("csv"), F.col("idx").alias("at"), F.concat(
        F.when(F.col("idx") == 0, F.lit(bridge.CSV_HEADER + "\r\n")).otherwise(F.lit("")), bridge.csv_line(), F.lit("\n")).alias("text"))
    plain_texts = lr.select(origin("plain"), F.col("idx").alias("at"), F.concat("message", F.lit("\r\n")).alias("text"))
    events = bridge.log4j_event(lr).where("idx % 101 <> 0").select(
        origin("log4j"), F.col("idx").alias("at"), F.col("event").alias("text"))
    stream = bridge.payload_stream(spark, sf_dir, csv_texts.unionByName(plain_texts).unionByName(events), "auto")
    return _framed(spark, stream, "auto").select(
        F.split("origin.origin", "-")[0].alias("kind"), F.split("origin.origin", "-")[1].cast("bigint").alias("src"), "level", "message")


# ------------------------------------------------------------------ detection

_KINDS = """select src, kind, fmt from (select distinct src from lr),
(values ('csv', 'csv'), ('log4j', 'log4j'), ('plain', 'plain')) as t(kind, fmt)"""


def _mixed_heads(spark, sf_dir):
    paths = [log_files(spark, sf_dir, k) for k in ("csv", "log4j", "plain")]
    return read_heads(spark, paths)


def _kind():
    return F.regexp_extract("source", r"/logs-([a-z0-9]+)-", 1).alias("kind")


@query("detect_format", LR + f"select src, kind, fmt as format from ({_KINDS})")
def detect_format(spark, sf_dir):
    return _with_src(detect.detect_format(_mixed_heads(spark, sf_dir)), _kind(), "format")


@query("detect_candidates", LR + f"""
select src, kind, case when fmt = 'plain' then '' else fmt end as candidates from ({_KINDS})""")
def detect_candidates(spark, sf_dir):
    return _with_src(detect.detect_candidates(_mixed_heads(spark, sf_dir)), _kind(),
                     F.array_join("candidates", ",").alias("candidates"))


@query("mixed_level_counts", LR + """
select 'csv' as kind, level, count(*) as count from lr
where level is not null and idx % 97 <> 96 group by level
union all
select 'log4j', level, count(*) from lr
where level is not null and idx % 101 <> 0 group by level""")
def mixed_level_counts(spark, sf_dir):
    paths = [log_files(spark, sf_dir, k) for k in ("csv", "log4j", "plain")]
    # Counts need no record numbers, so XML and plain text stay plain scans.
    scans = {"log4j": {"index": False}, "plain": {"index": False}}
    records = read_logs(spark, paths, options=scans)
    return stats.level_counts(records.withColumn("kind", _kind()), "kind")


# ------------------------------------------------------------------ csv

@query("csv_delimiter", LR + "select distinct src, ';' as delimiter from lr")
def csv_delimiter(spark, sf_dir):
    lines = scan_units(spark, log_files(spark, sf_dir, "csv"), head=1)
    header = F.regexp_replace("value", r"\r\z", "")
    return _with_src(lines, csv_format.guess_delimiter(header).alias("delimiter"))


@query("csv_header_map", LR + """
select distinct src, 7 as n_fields, 0 as time_at, 1 as level_at, 2 as logger_at,
  3 as message_at, 4 as exception_at, '5=user,6=k' as attributes from lr""")
def csv_header_map(spark, sf_dir):
    heads = scan_units(spark, log_files(spark, sf_dir, "csv"), head=1).select(
        "source", F.col("value").alias("header"))
    extra = F.transform("attributes", lambda a: F.concat(a["position"], F.lit("="), a["name"]))
    return _with_src(
        csv_format.header_layout(heads), "n_fields", F.col("timestamp_at").alias("time_at"),
        "level_at", "logger_at", "message_at", "exception_at",
        F.array_join(extra, ",").alias("attributes"))


@query("csv_segments", CSV_TEXT + 'select src, idx, "offset", length, raw from csv')
def csv_segments(spark, sf_dir):
    segments, _ = csv_format.csv_segments(scan_units(spark, log_files(spark, sf_dir, "csv")))
    return _with_src(segments, "idx", "offset", "length", "raw")


@query("csv_fields", CSV_TEXT + """
, f as (select src, idx, strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') as f0,
    coalesce(level, 'Notice') as f1, logger as f2, csv_message as f3, csv_exception as f4,
    "user" as f5, k as f6, case when idx % 97 = 96 then 'extra' end as f7 from csv)
select src, idx, pos, field from (
  select src, idx, 0 as pos, f0 as field from f union all select src, idx, 1, f1 from f
  union all select src, idx, 2, f2 from f union all select src, idx, 3, f3 from f
  union all select src, idx, 4, f4 from f union all select src, idx, 5, f5 from f
  union all select src, idx, 6, f6 from f union all select src, idx, 7, f7 from f)
where field is not null""")
def csv_fields(spark, sf_dir):
    segments, _ = csv_format.csv_segments(scan_units(spark, log_files(spark, sf_dir, "csv")))
    fields = F.posexplode(csv_format.split_fields(F.col("raw"), ";")).alias("pos", "field")
    return _with_src(segments, "idx", fields)


_CSV_RECORD = '''select src, idx, "offset", length, "timestamp", level, logger,
  csv_message as message, csv_exception as exception from csv where idx % 97 <> 96'''


@query("csv_parse", CSV_TEXT + _CSV_RECORD)
def csv_parse(spark, sf_dir):
    return _with_src(_csv(spark, sf_dir), "idx", "offset", "length", "timestamp", "level",
                     "logger", "message", "exception")


@query("csv_attributes", CSV_TEXT + """
select src, idx, name, case name when 'user' then "user" else k end as value
from csv, (values ('user'), ('k')) as t(name) where idx % 97 <> 96""")
def csv_attributes(spark, sf_dir):
    return _with_src(_csv(spark, sf_dir), "idx", F.explode("attributes").alias("name", "value"))


@query("csv_malformed", CSV_TEXT + """
select src, idx, case when idx % 97 = 96 then 'field count' end as malformed from csv""")
def csv_malformed(spark, sf_dir):
    return _with_src(_csv(spark, sf_dir, on_malformed="keep"), "idx", "malformed")


@query("csv_stop", CSV_TEXT + "select src, idx, csv_message as message from csv where idx < 96")
def csv_stop(spark, sf_dir):
    return _with_src(_csv(spark, sf_dir, on_malformed="stop"), "idx", "message")


@query("csv_headerless", CSV_TEXT + """
select src, idx + 1 as idx, "timestamp", level, csv_message as message, k as extra
from csv where idx % 97 <> 96
union all
select distinct src, 0, cast(null as timestamp), cast(null as varchar), 'message', 'k'
from csv""")
def csv_headerless(spark, sf_dir):
    layout = CsvLayout(7, timestamp=0, level=1, logger=2, message=3, exception=4,
                       attributes={"k": 6})
    return _with_src(_csv(spark, sf_dir, layout=layout), "idx", "timestamp", "level", "message",
                     F.col("attributes")["k"].alias("extra"))


# ------------------------------------------------------------------ log4j

def _log4j(spark, sf_dir, **kwargs):
    return read_logs(spark, log_files(spark, sf_dir, "log4j"), "log4j", **kwargs)


@query("log4j_segments", EVENT_TEXT + """
select src, idx, cast(coalesce(sum(strlen(raw) + 1) over (partition by src order by idx
    rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset",
  cast(strlen(raw) as bigint) as length, raw from xml""")
def log4j_segments(spark, sf_dir):
    units = scan_units(spark, log_files(spark, sf_dir, "log4j"), log4j.EVENT_END)
    return _with_src(log4j.log4j_segments(units), "idx", "offset", "length", "raw")


@query("log4j_parse", EVENT_TEXT + """
select src, idx, event_time as "timestamp", level, logger, thread, message, exception
from xml where idx % 101 <> 0""")
def log4j_parse(spark, sf_dir):
    return _with_src(_log4j(spark, sf_dir), "idx", "timestamp", "level", "logger", "thread",
                     "message", "exception")


@query("log4j_exception", EVENT_TEXT + """
select src, idx, exception from xml where idx % 101 <> 0 and exception is not null""")
def log4j_exception(spark, sf_dir):
    return _with_src(_log4j(spark, sf_dir).where("exception is not null"), "idx", "exception")


@query("log4j_time", LR + """
select src, idx, timestamp '1970-01-01' + to_seconds(cast(round_even(
    (epoch_us("timestamp") // 1000) / 1000.0, 0) as bigint)) as seconds,
  timestamp '1970-01-01' + to_milliseconds((epoch_us("timestamp") // 1000)) as millis from lr""")
def log4j_time(spark, sf_dir):
    millis = F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01'"), "timestamp")
    value = millis.cast("string")
    return log_records(spark, sf_dir).select(
        "src", "idx", times.epoch_millis(value).alias("seconds"),
        times.epoch_millis(value, "ms").alias("millis"))


@query("log4j_malformed", LR + """
select src, idx, case when idx % 101 = 0 then 'xml' end as malformed from lr""")
def log4j_malformed(spark, sf_dir):
    return _with_src(_log4j(spark, sf_dir, on_malformed="keep"), "idx", "malformed")


# ------------------------------------------------------------------ plain text and rules

@query("plain_segments", PLAIN_TEXT + 'select src, idx, "offset", length, line as raw from plain')
def plain_segments(spark, sf_dir):
    return _with_src(_plain_segments(spark, sf_dir), "idx", "offset", "length", "raw")


@query("plain_parse", PLAIN_TEXT + "select src, idx, line as message from plain")
def plain_parse(spark, sf_dir):
    records = read_logs(spark, log_files(spark, sf_dir, "plain"), "plain")
    return _with_src(records, "idx", "message")


@query("plain_scan", PLAIN_TEXT + "select src, line as message from plain")
def plain_scan(spark, sf_dir):
    records = read_logs(spark, log_files(spark, sf_dir, "plain"), "plain", index=False)
    return _with_src(records, "message")


@query("rules_segments", RULES_TEXT + """
select src, idx, "offset", cast(strlen(string_split(raw, chr(13) || chr(10))[1]) as bigint)
  as length, string_split(raw, chr(13) || chr(10))[1] as raw from ruled""")
def rules_segments(spark, sf_dir):
    units = scan_units(spark, log_files(spark, sf_dir, "rules"))
    return _with_src(rules.rule_segments(units, LINE_RULES), "idx", "offset", "length", "raw")


@query("rules_look_around", RULES_TEXT + """
select src, idx, "offset" + 20 as "offset", cast(strlen(raw) + 2 - case when lead(idx) over (
    partition by src order by idx) is null then 20 else 0 end as bigint) as length, substr(raw, 21, 9) as head
from ruled""")
def rules_look_around(spark, sf_dir):
    units = scan_units(spark, log_files(spark, sf_dir, "rules"))
    levels = rules.RuleSet("behind stamps", start="(?<={stamp} )(?=[A-Z])", definitions=RULES.definitions)
    segments = rules.rule_segments(units, levels).withColumn("head", F.substring("raw", 1, 9))
    return _with_src(segments, "idx", "offset", "length", "head")


@query("rules_across_lines", RULES_TEXT + """
, whole as (select *, max("offset" + strlen(raw) + 2) over (partition by src) as total from ruled)
select src, row_number() over (partition by src order by idx) - 1 as idx, "offset",
  coalesce(lead("offset") over (partition by src order by idx), total) - "offset" as length
from whole where message like '%' || chr(10) || 'more%'""")
def rules_across_lines(spark, sf_dir):
    """Records that begin where the line behind a stamp goes on with more."""
    units = scan_units(spark, log_files(spark, sf_dir, "rules"))
    more = rules.RuleSet("more", start="^{stamp}[^\\n]*\\nmore", start_lines=2, definitions=RULES.definitions)
    return _with_src(rules.rule_segments(units, more), "idx", "offset", "length")


@query("rules_parse", RULES_TEXT + """
select src, idx, date_trunc('second', "timestamp") as "timestamp", level, message, "offset",
  cast(strlen(raw) + 2 as bigint) as length from ruled""")
def rules_parse(spark, sf_dir):
    records = read_logs(spark, log_files(spark, sf_dir, "rules"), "rules", rules=RULES)
    return _with_src(records, "idx", "timestamp", "level", "message", "offset", "length")


def _stamped_scan():
    """A scanner by code: two words, then text in which a word after "more;" counts as the exception."""
    def scan(raw):
        stamp, level, message = raw.split(" ", 2)
        message, _, more = message.partition("\r\nmore; ")
        return {"timestamp": stamp, "level": level, "message": message, "exception": more.swapcase()}
    return scan


@query("scanner_parse", RULES_TEXT + """
select src, idx, date_trunc('second', "timestamp") as "timestamp", level,
  string_split(message, crlf)[1] as message,
  case when message like '%' || crlf || 'more; %' then 'FOR "' || "user" || '" AND OTHERS' end as exception
from (select *, chr(13) || chr(10) as crlf from ruled)""")
def scanner_parse(spark, sf_dir):
    units = scan_units(spark, log_files(spark, sf_dir, "rules"))
    records = scan_records(rules.rule_segments(units, RULES), _stamped_scan, RULES.timestamp_format)
    return _with_src(records, "idx", "timestamp", "level", "message", "exception")


@query("parse_timestamp", LR + """
select src, idx, case when idx % 4 <> 3 then date_trunc('second', "timestamp") end as parsed
from lr""")
def parse_timestamp(spark, sf_dir):
    shown = F.when(F.col("idx") % 4 == 3, F.lit("no date")).when(
        F.col("idx") % 4 == 2, F.date_format("timestamp", "MMM d, yyyy HH:mm:ss")).otherwise(
        F.date_format("timestamp", "dd.MM.yyyy'T'HH:mm:ss"))
    return log_records(spark, sf_dir).select(
        "src", "idx", times.parse_timestamp(
            shown, "dd.MM.yyyyTHH:mm:ss", "MMM d, yyyy HH:mm:ss").alias("parsed"))


# ------------------------------------------------------------------ scalar functions

@query("parse_level", LR + """
select src, idx, level as upper_case, case when idx % 3 = 0 then level end as some
from lr""")
def parse_level(spark, sf_dir):
    padded = F.when(F.col("idx") % 3 == 0, F.lower("level")).otherwise(
        F.concat(F.lit(" "), "level"))
    return log_records(spark, sf_dir).select(
        "src", "idx", levels.parse_level(F.upper("level")).alias("upper_case"),
        levels.parse_level(padded).alias("some"))


@query("level_ordinal", LR + """
select src, idx, cast(case level when 'Trace' then 0 when 'Debug' then 1 when 'Info' then 2
  when 'Warn' then 3 when 'Error' then 4 when 'Fatal' then 5 end as tinyint) as ordinal,
  coalesce(level in ('Warn', 'Error', 'Fatal'), false) as warn_or_worse from lr""")
def level_ordinal(spark, sf_dir):
    level = F.col("level")
    return log_records(spark, sf_dir).select(
        "src", "idx", levels.level_ordinal(level).alias("ordinal"),
        F.coalesce(levels.at_least(level, "Warn"), F.lit(False)).alias("warn_or_worse"))


@query("short_logger", LR + """
select logger, regexp_extract(logger, '[^.]*$') as short, count(*) as count from lr
group by all""")
def short_logger(spark, sf_dir):
    return log_records(spark, sf_dir).groupBy(
        "logger", text.short_logger(F.col("logger")).alias("short")).agg(
        F.count("*").alias("count"))


@query("flatten_message", LR + """
select src, idx, replace(message, chr(13) || chr(10), ' ' || chr(8203)) as flat from lr""")
def flatten_message(spark, sf_dir):
    return log_records(spark, sf_dir).select(
        "src", "idx", text.flatten_message(F.col("message")).alias("flat"))


@query("restore_message", LR + "select src, idx, message as restored from lr")
def restore_message(spark, sf_dir):
    return log_records(spark, sf_dir).select("src", "idx", text.restore_message(
        text.flatten_message(F.col("message"))).alias("restored"))


@query("format_timestamp", LR + """
select src, idx, strftime("timestamp", '%H:%M:%S') as short,
  strftime("timestamp", '%Y-%m-%d %H:%M:%S') as long from lr""")
def format_timestamp(spark, sf_dir):
    time = F.col("timestamp")
    return log_records(spark, sf_dir).select(
        "src", "idx", text.format_timestamp(time, "short").alias("short"),
        text.format_timestamp(time, "long").alias("long"))


_LINES = LR + r""", lines as (
  select src, idx, unnest(string_split(exception, crlf)) as line,
    cast(generate_subscripts(string_split(exception, crlf), 1) - 1 as int) as line_no
  from (select *, chr(13) || chr(10) as crlf from lr) where exception <> '')"""
_HEADER, _FRAME = f"'{exceptions.HEADER_PATTERN}'", f"'{exceptions.FRAME_PATTERN}'"


def _exception_lines(spark, sf_dir):
    return exceptions.exception_lines(log_records(spark, sf_dir))


@query("exception_lines", _LINES + rf"""
select src, idx, line_no, line, case when regexp_matches(line, {_HEADER}) then 'header'
  when regexp_matches(line, {_FRAME}) then 'frame' else 'other' end as kind from lines""")
def exception_lines(spark, sf_dir):
    return _exception_lines(spark, sf_dir).select("src", "idx", "line_no", "line", "kind")


@query("exception_header", _LINES + rf"""
select src, idx, regexp_extract(line, {_HEADER}, 1) as namespace,
  regexp_extract(line, {_HEADER}, 2) as class, regexp_extract(line, {_HEADER}, 3) as message
from lines where regexp_matches(line, {_HEADER})""")
def exception_header(spark, sf_dir):
    return _exception_lines(spark, sf_dir).where("kind = 'header'").select(
        "src", "idx", "header.*")


@query("stack_frames", _LINES + rf"""
select src, idx, line_no, regexp_extract(line, {_FRAME}, 1) as namespace,
  regexp_extract(line, {_FRAME}, 2) as class, regexp_extract(line, {_FRAME}, 3) as method,
  nullif(regexp_extract(line, {_FRAME}, 4), '') as params,
  nullif(regexp_extract(line, {_FRAME}, 5), '') as file,
  cast(nullif(regexp_extract(line, {_FRAME}, 6), '') as int) as file_line
from lines where regexp_matches(line, {_FRAME})""")
def stack_frames(spark, sf_dir):
    f = F.col("frame")
    return _exception_lines(spark, sf_dir).where("kind = 'frame'").select(
        "src", "idx", "line_no", *[f[part].alias(part) for part in (
            "namespace", "class", "method", "params", "file")], f["line_no"].alias("file_line"))


@query("render_frame", _LINES + r"""
select src, idx, line_no, replace(line, 'c:\src\', '') as frame
from lines where line like '   at %'""")
def render_frame(spark, sf_dir):
    return _exception_lines(spark, sf_dir).where("kind = 'frame'").select(
        "src", "idx", "line_no", exceptions.render_frame(F.col("frame")).alias("frame"))


@query("frame_file", _LINES + """
select 'Cart.cs' as file_name, count(*) as count from lines where line like '%Cart.cs:line%'""")
def frame_file(spark, sf_dir):
    frames = _exception_lines(spark, sf_dir).where("kind = 'frame'")
    return (frames.select(text.base_name(F.col("frame.file")).alias("file_name"))
            .where("file_name is not null").groupBy("file_name")
            .agg(F.count("*").alias("count")))


@query("format_counts", """
with c as (select user_id, count(*) * 997 - 997 as n, 100 * count(*) // 200 as pct
  from events group by user_id)
select user_id, case when n = 0 then '' else format('{:,}', n) end as shown,
  format('{:,}', n) || ' records' as records, pct || '%' as percent from c""")
def format_counts(spark, sf_dir):
    n = F.col("n")
    return (table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("c"))
            .withColumns({"n": F.col("c") * 997 - 997,
                          "pct": F.floor(F.lit(100) * F.col("c") / 200)})
            .select("user_id", text.format_count(n).alias("shown"),
                    text.format_records(n).alias("records"),
                    text.format_percent(F.col("pct")).alias("percent")))


_FOUND = """
with cut as (select doc_id, unnest(string_split(text, 'er')) as piece,
    generate_subscripts(string_split(text, 'er'), 1) as n from documents),
summed as (select doc_id, n, sum(strlen(piece) + 2) over (partition by doc_id order by n) - 2 as e,
    max(n) over (partition by doc_id) as last_n from cut),
found as (select doc_id, cast(n - 1 as int) as pos, cast(e as int) as "at"
  from summed where n < last_n)
"""


@query("occurrences", _FOUND + 'select doc_id, pos, "at" from found')
def occurrences(spark, sf_dir):
    hits = text.occurrences(F.col("text"), "er")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(hits).alias("pos", "at"))


@query("occurrences_file", PLAIN_TEXT + """
select src, "offset" + length - 2 as "at" from (
  select *, lead(line) over (partition by src order by idx, pos) as next from placed)
where next like 'user 1%'""")
def occurrences_file(spark, sf_dir):
    """A literal with a line break in whole files."""
    found = occurrences_in_files(spark, log_files(spark, sf_dir, "plain"), "\r\nuser 1")
    return _with_src(found, F.col("offset").alias("at"))


@query("occurrences_limit", _FOUND + 'select doc_id, pos, "at" from found where pos < 3')
def occurrences_limit(spark, sf_dir):
    hits = text.occurrences(F.col("text"), "er", limit=3)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(hits).alias("pos", "at"))


@query("occurrence_count", """
select doc_id, cast((strlen(text) - strlen(replace(text, 'er', ''))) / 2 as bigint) as n
from documents""")
def occurrence_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.occurrence_count(F.col("text"), "er").alias("n"))


# ------------------------------------------------------------------ search

@query("filter_levels", LR + """
select src, idx, level from lr where level in ('Warn', 'Error')""")
def filter_levels(spark, sf_dir):
    return searching.search(log_records(spark, sf_dir), levels=("Warn", "Error")).select(
        "src", "idx", "level")


_ANY = """select src, idx, level, message from lr where level is not null and ({})"""


@query("search_text", LR + _ANY.format("""
  coalesce(contains(lower(message), 'cart'), false) or
  coalesce(contains(lower(exception), 'cart'), false) or
  coalesce(contains(lower(logger), 'cart'), false)"""))
def search_text(spark, sf_dir):
    return searching.search(log_records(spark, sf_dir), "CART").select(
        "src", "idx", "level", "message")


@query("search_match_case", LR + _ANY.format("""
  coalesce(contains(message, 'Billing'), false) or
  coalesce(contains(exception, 'Billing'), false) or
  coalesce(contains(logger, 'Billing'), false)"""))
def search_match_case(spark, sf_dir):
    return searching.search(log_records(spark, sf_dir), "Billing", match_case=True).select(
        "src", "idx", "level", "message")


@query("search_regex", LR + _ANY.format("""
  coalesce(regexp_matches(message, 'user [0-9]*7 (click|view)'), false) or
  coalesce(regexp_matches(exception, 'user [0-9]*7 (click|view)'), false) or
  coalesce(regexp_matches(logger, 'user [0-9]*7 (click|view)'), false)"""))
def search_regex(spark, sf_dir):
    return searching.search(log_records(spark, sf_dir), "USER [0-9]*7 (click|VIEW)",
                            regex=True).select("src", "idx", "level", "message")


@query("search_inactive", LR + "select src, idx, level, message from lr")
def search_inactive(spark, sf_dir):
    return searching.search(log_records(spark, sf_dir), "").select(
        "src", "idx", "level", "message")


@query("search_documents", """
select d.doc_id, d.line_no, d.line from (
  select doc_id, unnest(string_split(text, chr(10))) as line,
    cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as int) as line_no
  from documents) d
where contains(lower(line), 'the')""")
def search_documents(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "message"))
    records = lines.withColumns({
        "level": F.lit("Info"), "exception": F.lit(None).cast("string"),
        "logger": F.lit(None).cast("string")})
    return searching.search(records, "the").select(
        "doc_id", "line_no", F.col("message").alias("line"))


@query("filter_predicate", LR + """
select src, idx, thread, message from lr where thread = '3' and strlen(message) > 25""")
def filter_predicate(spark, sf_dir):
    return searching.filter_records(
        log_records(spark, sf_dir),
        (F.col("thread") == "3") & (F.octet_length("message") > 25)).select(
        "src", "idx", "thread", "message")


# ------------------------------------------------------------------ views

_VIEW = LR + """, view as (select *, row_number() over (partition by source order by idx) - 1
  as local_idx from lr where level in ('Error', 'Fatal'))"""


def _view(spark, sf_dir):
    # Small buckets, so that the given tables fill several of them.
    return views.filtered_view(log_records(spark, sf_dir),
                               F.col("level").isin("Error", "Fatal"))


@query("filtered_index", _VIEW + "select src, idx, local_idx, message from view")
def filtered_index(spark, sf_dir):
    return _view(spark, sf_dir).select("src", "idx", "local_idx", "message")


_ASKED = """, asked as (select distinct 'events-' || (o_custkey % 2) as source,
  o_custkey as {0} from orders where o_custkey is not null)"""


def _asked(spark, sf_dir, name):
    return table(spark, sf_dir, "orders").where("o_custkey is not null").select(
        F.concat(F.lit("events-"), F.col("o_custkey") % 2).alias("source"),
        F.col("o_custkey").alias(name)).distinct()


@query("filtered_lookup", _VIEW + _ASKED.format("local_idx") + """
select a.source, a.local_idx, v.idx, v.message from asked a left join view v
on v.source = a.source and v.local_idx = a.local_idx""")
def filtered_lookup(spark, sf_dir):
    return views.filtered_lookup(_view(spark, sf_dir), _asked(spark, sf_dir, "local_idx")).select(
        "source", "local_idx", "idx", "message")


@query("filtered_inverse", _VIEW + _ASKED.format("idx") + """
select a.source, a.idx, coalesce(v.local_idx, -1) as local_idx from asked a left join view v
on v.source = a.source and v.idx = a.idx""")
def filtered_inverse(spark, sf_dir):
    return views.local_index_of(_view(spark, sf_dir), _asked(spark, sf_dir, "idx"))


@query("zip_starts_ends", """
with s as (select page_id, unnest(string_split(html, '<li>')) as piece,
    generate_subscripts(string_split(html, '<li>'), 1) as n from pages),
s2 as (select page_id, n, sum(strlen(piece) + 4) over (partition by page_id order by n) - 4 as "at",
    max(n) over (partition by page_id) as m from s),
e as (select page_id, unnest(string_split(html, '</li>')) as piece,
    generate_subscripts(string_split(html, '</li>'), 1) as n from pages),
e2 as (select page_id, n, sum(strlen(piece) + 5) over (partition by page_id order by n) - 5 as "at",
    max(n) over (partition by page_id) as m from e)
select s2.page_id as source, cast(s2.n - 1 as int) as ordinal, cast(s2."at" as int) as start_at,
  cast(e2."at" as int) as end_at
from s2 join e2 on s2.page_id = e2.page_id and s2.n = e2.n
where s2.n < s2.m and e2.n < e2.m""")
def zip_starts_ends(spark, sf_dir):
    html = table(spark, sf_dir, "pages").select(F.col("page_id").alias("source"), "html")
    return views.zip_lists(html, text.occurrences(F.col("html"), "<li>"), text.occurrences(F.col("html"), "</li>"))


@query("filtered_status", LR + """
select source, count(*) filter (level = 'Error') as count,
  cast(max(100 * (idx + 1) // 8000) as bigint) as progress,
  max(100 * (idx + 1) // 8000) < 100 as is_processing_saved_data from lr group by source""")
def filtered_status(spark, sf_dir):
    df = log_records(spark, sf_dir).withColumn(
        "progress", F.floor(F.lit(100) * (F.col("idx") + 1) / 8000))
    return status.filtered_status(df, F.col("level") == "Error")


# ------------------------------------------------------------------ statistics

@query("level_counts", LR + """
select level, count(*) as count from lr where level is not null group by level""")
def level_counts(spark, sf_dir):
    return stats.level_counts(log_records(spark, sf_dir))


@query("level_counts_wide", LR + "select source, " + ", ".join(
    f"count(*) filter (level = '{name}') as {name.lower()}_count" for name in LEVELS)
    + " from lr group by source")
def level_counts_wide(spark, sf_dir):
    return stats.level_counts_wide(log_records(spark, sf_dir), "source")


@query("level_index", LR + """
select source, level, row_number() over (partition by source, level order by idx) - 1 as pos, idx
from lr where level is not null""")
def level_index(spark, sf_dir):
    return stats.level_index(log_records(spark, sf_dir))


@query("record_count", LR + "select count(*) as count from lr where level = 'Warn'")
def record_count(spark, sf_dir):
    return stats.record_count(searching.search(log_records(spark, sf_dir), levels=("Warn",)))


@query("batch_level_counts", LR + """
select source, idx // 1024 as batch, level, count(*) as count from lr
where level is not null group by all""")
def batch_level_counts(spark, sf_dir):
    return stats.batch_level_counts(log_records(spark, sf_dir), 1024)


@query("batch_status", LR + """
, n as (select source, count(*) as c from lr group by source),
s as (select source, idx, idx + 1 as count, idx + 1 < c as busy,
  cast(100 * (idx + 1) // c as int) as progress from lr join n using (source))
select source, idx // 1024 as batch, max(count) as count, arg_max(busy, idx) as busy,
  max(progress) as progress from s group by all""")
def batch_status(spark, sf_dir):
    lr = log_records(spark, sf_dir).select(
        "source", "idx", F.col("idx").alias("offset"), F.lit(1).alias("length"))
    sizes = lr.groupBy("source").agg(F.count("*").alias("size"))
    return stats.batch_status(status.record_status(lr, sizes), 1024).select(
        "source", "batch", F.col("status.count").alias("count"),
        F.col("status.is_processing_saved_data").alias("busy"), "progress")


# ------------------------------------------------------------------ navigation

@query("next_record", LR + """
select source, min(idx) as next_idx from lr where level = 'Fatal' and idx > 500
group by source""")
def next_record(spark, sf_dir):
    return navigate.next_record(log_records(spark, sf_dir), "Fatal", 500)


@query("next_by_level", LR + "select source, idx, " + ", ".join(
    f"min(case when level = '{name}' then idx end) over w as next_{name.lower()}"
    for name in LEVELS) + """ from lr
window w as (partition by source order by idx rows between 1 following and unbounded following)""")
def next_by_level(spark, sf_dir):
    return navigate.next_by_level(log_records(spark, sf_dir))


@query("next_of_cursors", LR + """, asked as (
  select o_orderkey as cursor, 'events-' || (o_custkey % 5) as source, o_custkey * 13 - 1 as after from orders where o_custkey is not null),
found as (select a.source, a.after, """ + ", ".join(
    f"min(case when level = '{name}' then idx end) as next_{name.lower()}" for name in LEVELS) + """
  from (select distinct source, after from asked) a left join lr on lr.source = a.source and lr.idx > a.after group by all)
select a.cursor, a.source, a.after, f.* exclude (source, after) from asked a join found f on a.source = f.source and a.after = f.after""")
def next_of_cursors(spark, sf_dir):
    cursors = table(spark, sf_dir, "orders").where("o_custkey is not null").select(
        F.col("o_orderkey").alias("cursor"), F.concat(F.lit("events-"), F.col("o_custkey") % 5).alias("source"),
        (F.col("o_custkey") * 13 - 1).alias("after"))
    return navigate.next_of_cursors(log_records(spark, sf_dir), cursors)


@query("last_record", """
select cast(conv_id as varchar) as source, max(turn) as idx, arg_max(role, turn) as role,
  arg_max(text, turn) as message from conversations group by conv_id""")
def last_record(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("source"), F.col("turn").alias("idx"), "role",
        F.col("text").alias("message"))
    return navigate.last_record(talks)


@query("tail_n", LR + """
select source, idx, message from lr where source = 'events-0' order by idx desc limit 25""")
def tail_n(spark, sf_dir):
    return navigate.tail_n(log_records(spark, sf_dir).select("source", "idx", "message"), 25,
                           "events-0")


# ------------------------------------------------------------------ time windows

@query("status_sampled", LR + """
select time_bucket(interval '2 seconds', "timestamp") as start, arg_max(n, ("timestamp", n)) as n
from (select "timestamp", src * 4000 + idx as n from lr) group by 1""")
def status_sampled(spark, sf_dir):
    numbered = log_records(spark, sf_dir).withColumn("n", F.col("src") * 4000 + F.col("idx"))
    return stats.status_sampled(numbered, value="n")


@query("debounced_events", """
with g as (select user_id, event_id, ts, case when ts - lag(ts) over w <= interval '30 minutes'
    then 0 else 1 end as starts from events
  window w as (partition by user_id order by event_id)),
b as (select *, sum(starts) over (partition by user_id order by event_id) as burst from g)
select user_id, min(ts) as first_at, max(ts) as last_at, max(event_id) as event_id
from b group by user_id, burst""")
def debounced_events(spark, sf_dir):
    return stats.debounced(table(spark, sf_dir, "events"), "user_id", time="ts",
                           order="event_id", quiet="30 minutes")


# ------------------------------------------------------------------ streams

def _finish(writer, out: str) -> None:
    """Run a stream over all there is."""
    query = writer.option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start()
    query.awaitTermination()


def _followed(spark, sf_dir, kind, follower):
    out = new_path(spark, f"followed-{kind}")
    units = tail_units(spark, log_files(spark, sf_dir, kind), follower.separator)
    _finish(follow.write_records(units, follower, out), out)
    return follow.read_written(spark, out)


@query("stream_tail_file", CSV_TEXT + _CSV_RECORD)
def stream_tail_file(spark, sf_dir):
    records = _followed(spark, sf_dir, "csv", follow.follow_csv())
    return _with_src(records, "idx", "offset", "length", "timestamp", "level", "logger",
                     "message", "exception")


@query("stream_record_bound", PLAIN_TEXT + """
, n as (select count(*) as n from placed)
select batch, least(8192, n - 8192 * batch) as count from n, range(0, 1 + (n - 1) // 8192) as b(batch)""")
def stream_record_bound(spark, sf_dir):
    """Lines of each micro-batch of a followed folder; a batch takes 8,192 of all files together."""
    units = tail_units(spark, log_files(spark, sf_dir, "plain"), max_records_per_trigger=8192)
    counts, progress = live.BatchCounts(), new_path(spark, "record-bound-progress")
    try:
        with checkpoint_files(spark, progress):
            running = (units.writeStream.foreachBatch(counts).option("checkpointLocation", progress)
                       .trigger(processingTime="0 seconds").start())
        try:
            running.processAllAvailable()
        finally:
            running.stop()
        rows = sorted(counts.result().items())
    finally:
        counts.close()
    return spark.createDataFrame(rows, "batch bigint, count bigint")


@query("stream_replay", EVENT_TEXT + """
select src, idx, event_time as "timestamp", level, message from xml where idx % 101 <> 0""")
def stream_replay(spark, sf_dir):
    records = _followed(spark, sf_dir, "log4j", follow.follow_log4j())
    return _with_src(records, "idx", "timestamp", "level", "message")


@query("stream_dump_sink", EVENT_TEXT + """
select level, thread, message from xml where idx % 101 <> 0""")
def stream_dump_sink(spark, sf_dir):
    out = new_path(spark, "dump")
    events = bridge.log4j_event(log_records(spark, sf_dir, stream=True))
    value = F.when(F.col("idx") % 101 == 0, F.lit("")).otherwise(F.col("event"))
    _finish(live.dump_payloads(events.select(F.encode(value, "UTF-8").alias("value")), out), out)
    return read_logs(spark, out, "log4j", index=False).select("level", "thread", "message")


@query("stream_level_counts", LR + """
select level, count(*) as count from lr where level is not null and idx % 101 <> 0
group by level""")
def stream_level_counts(spark, sf_dir):
    out = new_path(spark, "level-counts")
    units = tail_units(spark, log_files(spark, sf_dir, "log4j"), log4j.EVENT_END)
    records = log4j.parse_log4j(log4j.log4j_segments(units, index=False))
    _finish(live.write_latest(live.running_level_counts(records), out), out)
    return live.read_latest(spark, out)


@query("stream_filtered_view", _VIEW + "select source, idx, local_idx, message from view")
def stream_filtered_view(spark, sf_dir):
    out = new_path(spark, "filtered-view")
    records = log_records(spark, sf_dir, stream=True)
    _finish(follow.write_filtered_view(records, F.col("level").isin("Error", "Fatal"), out), out)
    return follow.read_written(spark, out, "view").select("source", "idx", "local_idx", "message")


@query("stream_status", LR + """
select source, count(*) as count, max(idx * 10 + 10) as "end" from lr group by source""")
def stream_status(spark, sf_dir):
    out = new_path(spark, "status")
    segments = log_records(spark, sf_dir, stream=True).select(
        "source", (F.col("idx") * 10).alias("offset"), F.lit(10).alias("length"))
    _finish(live.write_latest(live.running_status(segments), out), out)
    return live.read_latest(spark, out)


@query("stream_level_index", LR + """
select source, min(idx) as next_idx from lr where level = 'Fatal' and idx > 500
group by source""")
def stream_level_index(spark, sf_dir):
    out = new_path(spark, "level-index")
    _finish(live.write_level_index(log_records(spark, sf_dir, stream=True), out), out)
    return navigate.next_record(spark.read.parquet(out), "Fatal", 500)


@query("stream_status_progress", PLAIN_TEXT + """
, size as (select src, sum(length) as size from placed group by src),
done as (select src, count(*) as n, max("offset" + length) as e from plain group by src)
select src, cast(n as bigint) as count, cast(e as bigint) as "end", e < size as is_processing_saved_data,
  cast(100 * e // size as int) as progress from done join size using (src)""")
def stream_status_progress(spark, sf_dir):
    """The written records of a followed folder, as a stream with the size of their file."""
    out, records = new_path(spark, "status-progress"), new_path(spark, "status-records")
    segments = _plain_segments(spark, sf_dir).select("source", "offset", "length")
    sized = segments.join(_sized(spark, sf_dir), "source")
    sized.write.parquet(records)
    stream = spark.readStream.schema(sized.schema).option("maxFilesPerTrigger", 3).parquet(records)
    _finish(live.write_latest(live.running_status(stream), out), out)
    return _with_src(live.read_latest(spark, out), "count", "end", "is_processing_saved_data", "progress")


@query("stream_status_sampled", LR + """
select time_bucket(interval '2 seconds', "timestamp") as start, arg_max(n, ("timestamp", n)) as n
from (select "timestamp", src * 4000 + idx as n from lr) group by 1""")
def stream_status_sampled(spark, sf_dir):
    out = new_path(spark, "status-sampled")
    numbered = log_records(spark, sf_dir, stream=True).select(
        F.col("timestamp").cast("timestamp").alias("timestamp"), (F.col("src") * 4000 + F.col("idx")).alias("n"))
    _finish(live.write_latest(stats.status_sampled_stream(numbered, value="n"), out), out)
    return live.read_latest(spark, out).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")
