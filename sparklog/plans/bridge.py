"""Log records and log files derived from the given tables.

The tables hold no log files, so ``log_records`` turns ``events`` into records, and the
renderers write these as files of each format for the readers to take apart again. Sources
are ranges of events; their length grows with the table, so the number of files stays bounded.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import scratch
from ..formats.rules import FieldRule, RuleSet

MIN_SOURCE_ROWS = 4_000
MAX_SOURCES = 10_000
# Events per file of a payload stream's micro-batch, of which there are at least four files.
PAYLOAD_FILE_EVENTS = 50_000

CSV_HEADER = "time;level;logger;message;exception;user;k"

RULES = RuleSet(
    name="stamped lines",
    definitions={"two": "[0-9][0-9]", "stamp": "{two}[.]{two}[.][0-9]{4}T{two}:{two}:{two}"},
    start="^{stamp}",
    fields=(FieldRule("timestamp", "{stamp}", state_from="INITIAL", state_to="LEVEL"),
            FieldRule("level", "[A-Z]+", state_from="LEVEL", state_to="TEXT"),
            FieldRule("message", r"(?s)\S.*", state_from="TEXT")),
    timestamp_format="dd.MM.yyyyTHH:mm:ss",
)
LINE_RULES = RuleSet(name="first lines", definitions=RULES.definitions, start=RULES.start,
                     end=r"\r\n", fields=RULES.fields, timestamp_format=RULES.timestamp_format)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_rows(events: DataFrame) -> int:
    """Events per source; the count is read from Parquet footers."""
    return max(MIN_SOURCE_ROWS, -(-events.count() // MAX_SOURCES))


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return (spark.readStream.schema(table(spark, sf_dir, name).schema)
            .option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir))


def log_records(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """One record per event: ``src``, ``source``, ``idx`` dense per source, and the fields."""
    events = table(spark, sf_dir, "events")
    rows = source_rows(events)
    if stream:
        events = stream_table(spark, sf_dir, "events")
    crlf = F.lit("\r\n")
    kind, user = F.col("event_type"), F.col("user_id")
    k = F.regexp_extract("props", "[0-9]+", 0)
    level = (F.when(user % 50 == 0, None)
             .when(kind == "view", "Trace").when(kind == "click", "Debug")
             .when(kind == "signup", "Info").when(kind == "purchase", "Warn")
             .when((kind == "error") & (F.col("value") >= 150), "Fatal")
             .when(kind == "error", "Error"))
    area = F.when(kind == "purchase", "Billing.").otherwise("Web.")
    second = F.when(F.col("event_id") % 10 == 0,
                    F.concat(crlf, F.lit('more; for "'), user, F.lit('" and others')))
    trace = F.concat(
        F.lit("System.InvalidOperationException: bad k"), crlf,
        F.lit("   at Shop.Web.Cart.Add(Int32 k) in c:\\src\\Cart.cs:line "), k,
        F.when(k.cast("int") % 2 == 1, F.concat(crlf, F.lit("   at Shop.Web.Cart.Run()")))
         .otherwise(F.lit("")),
        F.when(k.cast("int") % 5 == 0, F.concat(crlf, F.lit("end of trace"))).otherwise(F.lit("")))
    src = F.expr(f"event_id div {rows}")
    return events.select(
        src.alias("src"), F.concat(F.lit("events-"), src).alias("source"),
        (F.col("event_id") % rows).alias("idx"), F.col("ts").alias("timestamp"),
        level.alias("level"), F.concat(F.lit("Shop."), area, kind).alias("logger"),
        (user % 8).cast("string").alias("thread"),
        F.concat(F.lit("user "), user, F.lit(" "), kind, F.lit(" k="), k,
                 F.coalesce(second, F.lit(""))).alias("message"),
        F.when(kind == "error", trace).alias("exception"),
        user.cast("string").alias("user"), k.alias("k"))


def csv_line() -> Column:
    """A record as delimited text; one in 97 has a field too many."""
    def quoted(c):
        return F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')),
                        F.lit('"'))

    return F.concat(F.concat_ws(
        ";", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        F.coalesce("level", F.lit("Notice")), "logger", quoted(F.col("message")),
        quoted(F.col("exception")), "user", "k",
        F.when(F.col("idx") % 97 == 96, F.lit("extra"))), F.lit("\r"))


def render_csv(lr: DataFrame) -> DataFrame:
    """Rows ``src, ord, value``."""
    header = lr.select("src").distinct().select(
        "src", F.lit(-1).cast("bigint").alias("ord"), F.lit(CSV_HEADER + "\r").alias("value"))
    return lr.select("src", F.col("idx").alias("ord"), csv_line().alias("value")).unionByName(header)


def log4j_event(lr: DataFrame) -> DataFrame:
    """Adds ``event``, the record as XML."""
    def escaped(c):
        for raw, code in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"), ("\r", "&#13;"),
                          ("\n", "&#10;")):
            c = F.replace(c, F.lit(raw), F.lit(code))
        return c

    millis = F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01'"), "timestamp")
    data = F.coalesce(F.concat(F.lit('<log4j:data name="exception" value="'),
                               escaped(F.col("exception")), F.lit('" />')), F.lit(""))
    return lr.withColumn("event", F.concat(
        F.lit('<log4j:event logger="'), F.col("logger"), F.lit('" level="'),
        F.upper(F.coalesce("level", F.lit("Notice"))), F.lit('" timestamp="'), millis,
        F.lit('" thread="'), F.col("thread"), F.lit('"><log4j:message>'),
        escaped(F.col("message")), F.lit("</log4j:message><log4j:properties>"), data,
        F.lit('<log4j:data name="user" value="'), F.col("user"),
        F.lit('" /></log4j:properties></log4j:event>')))


def render_log4j(lr: DataFrame) -> DataFrame:
    """Each 101st event lacks the end of its message."""
    event = F.when(F.col("idx") % 101 == 0,
                   F.replace("event", F.lit("</log4j:message>"), F.lit(""))).otherwise(F.col("event"))
    return log4j_event(lr).select("src", F.col("idx").alias("ord"), event.alias("value"))


def render_plain(lr: DataFrame) -> DataFrame:
    """The message lines; an empty line follows each seventh record."""
    gap = F.when(F.col("idx") % 7 == 0, F.lit("\n\r")).otherwise(F.lit(""))
    return lr.select("src", F.col("idx").alias("ord"),
                     F.concat("message", F.lit("\r"), gap).alias("value"))


def render_rules(lr: DataFrame) -> DataFrame:
    return lr.select("src", F.col("idx").alias("ord"), F.concat(
        F.date_format("timestamp", "dd.MM.yyyy'T'HH:mm:ss"), F.lit(" "),
        F.upper(F.coalesce("level", F.lit("Notice"))), F.lit(" "), "message",
        F.lit("\r")).alias("value"))


_RENDERERS = {"csv": render_csv, "log4j": render_log4j, "plain": render_plain,
              "rules": render_rules}
_WRITTEN: dict[tuple, str] = {}


def log_files(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """Folder with one log file per source, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _WRITTEN:
        path = scratch.new_path(spark, f"logs-{kind}")
        (_RENDERERS[kind](log_records(spark, sf_dir))
         .repartition("src").sortWithinPartitions("src", "ord")
         .select("src", "value").write.partitionBy("src").text(path))
        _WRITTEN[key] = path
    return _WRITTEN[key]


def payload_stream(spark: SparkSession, sf_dir: str, texts: DataFrame, name: str) -> DataFrame:
    """Stream of payloads ``origin, at, part, value`` made of ``texts`` (origin, at, text): each text is cut at
    two of its bytes, inside of characters too. Three micro-batches bring the thirds of each origin."""
    data = F.encode("text", "UTF-8")
    place = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "origin", "at"), F.octet_length("text") + 1).cast("int")
    cuts = F.array(F.lit(0), F.least("a", "b"), F.greatest("a", "b"), F.octet_length("text"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.substr(
        data, F.get(cuts, i) + 1, F.get(cuts, i + 1) - F.get(cuts, i)))
    payloads = texts.withColumns({"a": place(1), "b": place(2)}).select(
        "origin", "at", F.posexplode(parts).alias("part", "value")).where(F.octet_length("value") > 0)
    path = scratch.new_path(spark, f"payloads-{name}")
    events = table(spark, sf_dir, "events")
    # An origin's third lies in one file, so its payloads keep their order whichever files a micro-batch takes.
    files, rows = max(4, -(-events.count() // PAYLOAD_FILE_EVENTS)), source_rows(events)
    third = F.expr(f"at * 3 div {rows}")
    for n in range(3):
        payloads.where(third == n).repartition(files, "origin").write.mode("append").parquet(path)
    return (spark.readStream.schema(payloads.schema).option("maxFilesPerTrigger", files).parquet(path))


def file_src(source="source"):
    """Source number of a rendered file, from its folder."""
    return F.regexp_extract(source, r"/src=(\d+)/", 1).cast("bigint")
