"""Fixed schemas and fixed values shared by every module."""

from pyspark.sql import types as T

# Severity names in rising order; the position is the ordinal.
LEVELS = ("Trace", "Debug", "Info", "Warn", "Error", "Fatal")

RECORD_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("idx", T.LongType()),
    T.StructField("offset", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("level", T.StringType()),
    T.StructField("logger", T.StringType()),
    T.StructField("thread", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("exception", T.StringType()),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("raw", T.StringType()),
    T.StructField("malformed", T.StringType()),
])

RECORD_COLUMNS = tuple(RECORD_SCHEMA.fieldNames())

SEGMENT_COLUMNS = ("source", "idx", "offset", "length", "raw")
