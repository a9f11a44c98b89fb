"""How far a source has been read."""

from pyspark.sql import DataFrame, functions as F

from ..formats.common import join_small


def source_status(segments: DataFrame, sizes: DataFrame) -> DataFrame:
    """Records so far, whether text is left behind the last record, and whole percent done.

    Segments are reduced to one row per source before they meet the file sizes.
    """
    done = segments.groupBy("source").agg(
        F.count("*").alias("count"), F.max(F.col("offset") + F.col("length")).alias("end"))
    return sizes.join(done, "source").select(
        "source", "count", (F.col("end") < F.col("size")).alias("is_processing_saved_data"),
        F.floor(100 * F.col("end") / F.col("size")).cast("int").alias("progress"))


def resume_offset(segments: DataFrame) -> DataFrame:
    """Where reading goes on after the last complete record."""
    return segments.groupBy("source").agg(
        F.max(F.col("offset") + F.col("length")).alias("resume_offset"))


def record_status(segments: DataFrame, sizes: DataFrame) -> DataFrame:
    """Status as seen by each record: its count, whether more follows, percent at its end."""
    end = F.col("offset") + F.col("length")
    return join_small(segments, sizes, "source", "inner").select(
        *segments.columns,
        F.struct((F.col("idx") + 1).alias("count"),
                 (end < F.col("size")).alias("is_processing_saved_data"),
                 F.floor(100 * end / F.col("size")).cast("int").alias("progress")).alias("status"))


def filtered_status(df: DataFrame, predicate, progress: str = "progress") -> DataFrame:
    """Matches so far, progress over all records, matching or not, and whether saved data are
    still read: as long as the progress is below 100."""
    return df.groupBy("source").agg(
        F.count_if(predicate).alias("count"), F.max(progress).alias("progress"),
        (F.max(progress) < 100).alias("is_processing_saved_data"))
