"""Log4J XML events, one after the other in a text without a root element."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.levels import parse_level
from ..functions.times import epoch_millis
from ..operators.blocks import is_compressed, number_blocks, number_units
from ..sources.files import scan_units
from .common import apply_malformed_policy, to_records, with_once

# The tags that open and close an event.
EVENT_START = "<log4j:event "
EVENT_END = "</log4j:event>"

_EVENT = ("_level string, _logger string, _thread string, _timestamp string, "
          "message array<string>, "
          "properties array<struct<data array<struct<_name string, _value string>>>>, "
          "_corrupt string")


def _events(piece: Column) -> Column:
    """Texts that begin with a start tag. All but the last one miss their end tag."""
    return F.filter(F.split(piece, f"(?={EVENT_START})"),
                    lambda x: F.startswith(x, F.lit(EVENT_START)))


def _raw(event: Column, last: Column) -> Column:
    return F.make_valid_utf8(F.when(last, F.concat(event, F.lit(EVENT_END))).otherwise(event))


_LAST = "pos = size(events) - 1"


def weigh_pieces(units: DataFrame) -> DataFrame:
    return units.withColumn("weight", F.size(_events(F.col("value"))))


def log4j_segments(units: DataFrame, index: bool = True) -> DataFrame:
    """Units are pieces between two end tags. Text in front of the first start tag belongs to
    no record, and neither does a truncated event at the end of a file. ``index=False`` is for
    units that are known to be complete, such as those of a followed file."""
    if not index:
        return (units.withColumn("events", _events(F.col("value")))
                .select("source", "events", F.posexplode("events").alias("pos", "event"))
                .select("source", _raw(F.col("event"), F.expr(_LAST)).alias("raw")))
    units = weigh_pieces(units)
    whole = F.col("offset") + F.col("width") <= F.col("size")
    return _placed_events(
        number_units(units, number_blocks(units, len(EVENT_END)))
        .where(whole | is_compressed(F.col("source"))))


def placed_pieces(units: DataFrame, blocks: DataFrame) -> DataFrame:
    return _placed_events(number_units(units, blocks))


def _placed_events(placed: DataFrame) -> DataFrame:
    """One row per event. The text is split again here: cheaper than moving each text twice
    through Arrow."""
    def bytes_of(texts):
        return F.aggregate(texts, F.lit(0), lambda acc, x: acc + F.octet_length(x))

    last = F.expr(_LAST)
    lead = F.octet_length("value") - bytes_of("events")
    before = bytes_of(F.slice("events", F.lit(1), F.col("pos")))
    tag = F.when(last, F.lit(len(EVENT_END))).otherwise(F.lit(0))
    return (placed.withColumn("events", _events(F.col("value")))
            .select("*", F.posexplode("events").alias("pos", "event"))
            .select("source",
                    (F.col("idx") + F.col("pos")).alias("idx"),
                    (F.col("offset") + lead + before).alias("offset"),
                    (F.octet_length("event") + tag).cast("bigint").alias("length"),
                    _raw(F.col("event"), last).alias("raw")))


def parse_event(raw: Column) -> Column:
    """Event text as a struct; ``_corrupt`` is set when it is no well-formed XML."""
    return F.from_xml(raw, F.lit(_EVENT), {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt",
        "ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"})


def event_exception(event: Column) -> Column:
    """Value of the first property named ``exception``."""
    data = F.get(event["properties"], 0)["data"]
    return F.get(F.filter(data, lambda d: d["_name"] == "exception"), 0)["_value"]


def _event_attributes(event: Column) -> Column:
    data = F.get(event["properties"], 0)["data"]
    named = F.filter(data, lambda d: d["_name"].isNotNull() & (d["_name"] != "exception"))
    return F.aggregate(
        named, F.create_map().cast("map<string,string>"),
        lambda acc, d: F.map_concat(
            F.map_filter(acc, lambda k, _: k != d["_name"]), F.create_map(d["_name"], d["_value"])))


def parse_log4j(segments: DataFrame, precision: str = "s", attributes: bool = False,
                on_malformed: str = "drop") -> DataFrame:
    event = F.col("event")
    parsed = with_once(segments, "event", parse_event(F.col("raw")))
    records = parsed.withColumns({
        "level": parse_level(event["_level"]),
        "logger": event["_logger"],
        "thread": event["_thread"],
        "timestamp": epoch_millis(event["_timestamp"], precision),
        "message": F.get(event["message"], 0),
        "exception": event_exception(event),
        "malformed": F.when(event["_corrupt"].isNotNull(), F.lit("xml")),
    })
    if attributes:
        records = records.withColumn("attributes", _event_attributes(event))
    return apply_malformed_policy(to_records(records.drop("event")), on_malformed)


def read_log4j(spark: SparkSession, path, encoding: str = "UTF-8", index: bool = True,
               precision: str = "s", attributes: bool = False,
               on_malformed: str = "drop", head: int | None = None) -> DataFrame:
    """``index=False`` leaves record numbers and offsets out and stays a plain scan. It cannot
    tell a damaged event from a truncated one, so it only drops them."""
    if index:
        segments = log4j_segments(scan_units(spark, path, EVENT_END, encoding, head))
    elif on_malformed != "drop":
        raise ValueError("index=False only knows on_malformed='drop'")
    else:
        segments = _closed_events(scan_units(spark, path, EVENT_START, encoding, head))
    return parse_log4j(segments, precision, attributes, on_malformed)


def _closed_events(units: DataFrame) -> DataFrame:
    """Events from pieces between two start tags: here a missing end tag shows."""
    text = F.concat(F.lit(EVENT_START), F.substring_index("value", EVENT_END, 1), F.lit(EVENT_END))
    return (units.where(F.contains("value", F.lit(EVENT_END)))
            .select("source", F.make_valid_utf8(text).alias("raw")))
