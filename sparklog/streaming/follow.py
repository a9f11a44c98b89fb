"""Records of growing files: the batch transforms, continued from micro-batch to micro-batch.

Each source has one state row: the next record number and byte offset, its CSV header, and the
text of a record that is still open. State and records of micro-batch N are written to folders
named after N and derived from the state of N-1 only, so a repeated micro-batch writes the same
rows again and nothing is doubled or lost. Each state is a whole one: when that of N is written, only those of
N and N-1 can be asked for again, and older ones go. So do the helper tables of a micro-batch at its end.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import scratch
from ..formats import csv, log4j, plain, rules
from ..formats.common import join_small
from ..formats.rules import RuleSet
from ..operators.blocks import (
    glue_records, index_blocks, number_blocks, unfinished_records)
from ..operators.numbering import BUCKET, dense_number

STATE_SCHEMA = ("source string, next_idx bigint, next_offset bigint, header string, "
                "carry string, carry_bytes bigint")

Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class Follower:
    """How a format is followed: the separator of its units and the step per micro-batch."""

    separator: str
    step: Step


def _restart_replaced(units: DataFrame, state: DataFrame) -> DataFrame:
    """State without the sources whose file begins anew in this micro-batch."""
    anew = units.where("block = 0").select("source").distinct()
    return state.join(anew, "source", "left_anti")


def _advance(state: DataFrame, blocks: DataFrame, header: bool = False,
             open_records: DataFrame | None = None) -> DataFrame:
    """State after the micro-batch; sources without new text keep theirs."""
    seen = blocks.groupBy("source").agg(
        F.max(F.col("idx") + F.col("n")).alias("next_idx"),
        F.max(F.col("offset") + F.col("bytes")).alias("next_offset"),
        (F.max("file_header") if header else F.lit(None).cast("string")).alias("header"))
    if open_records is None:
        seen = seen.withColumns({"carry": F.lit(None).cast("string"),
                                 "carry_bytes": F.lit(0).cast("bigint")})
    else:
        held = open_records.select(
            "source", F.col("idx").alias("open_idx"), F.col("offset").alias("open_offset"),
            F.col("raw").alias("carry"), F.col("length").alias("carry_bytes"))
        seen = seen.join(held, "source", "left").withColumns({
            "next_idx": F.coalesce("open_idx", "next_idx"),
            "next_offset": F.coalesce("open_offset", "next_offset"),
            "carry_bytes": F.coalesce("carry_bytes", F.lit(0).cast("bigint"))})
    columns = ["source", "next_idx", "next_offset", "header", "carry", "carry_bytes"]
    kept = state.join(seen.select("source"), "source", "left_anti")
    return seen.select(*columns).unionByName(kept.select(*columns))


def _carried(units: DataFrame, state: DataFrame) -> DataFrame:
    """Open records of sources with new text, as a unit in front of that text."""
    return (state.where("carry_bytes > 0")
            .join(units.select("source").distinct(), "source", "left_semi")
            .select("source", F.col("next_offset").alias("block"),
                    F.lit(0).cast("bigint").alias("size"),
                    F.col("carry_bytes").alias("width"), F.col("carry").alias("value")))


def _check_policy(on_malformed: str) -> None:
    if on_malformed not in ("drop", "keep"):
        raise ValueError("a followed source knows on_malformed 'drop' and 'keep'")


def follow_plain() -> Follower:
    def step(units, state):
        lines = plain.weigh_lines(units)
        blocks = number_blocks(lines, origin=state)
        return plain.parse_plain(plain.placed_lines(lines, blocks)), _advance(state, blocks)
    return Follower("\n", step)


def follow_log4j(precision: str = "s", attributes: bool = False,
                 on_malformed: str = "drop") -> Follower:
    _check_policy(on_malformed)

    def step(units, state):
        pieces = log4j.weigh_pieces(units)
        blocks = number_blocks(pieces, len(log4j.EVENT_END), origin=state)
        records = log4j.parse_log4j(log4j.placed_pieces(pieces, blocks), precision, attributes,
                                    on_malformed)
        return records, _advance(state, blocks)
    return Follower(log4j.EVENT_END, step)


def follow_csv(delimiter: str | None = None, quote: str = '"', time_patterns: tuple = (),
               on_malformed: str = "drop") -> Follower:
    _check_policy(on_malformed)

    def step(units, state):
        lines = csv.quote_parity(units.unionByName(_carried(units, state)), quote)
        blocks = index_blocks(lines, quoted=True, header=True, origin=state, hold_open=True)
        known = state.select("source", F.col("header").alias("known_header"))
        blocks = blocks.join(known, "source", "left").withColumn(
            "file_header", F.coalesce("file_header", "known_header")).drop("known_header")
        blocks, headers = csv.number_headers(blocks)
        layout = csv.header_layout(headers, delimiter, quote)
        records = csv.parse_csv(csv.glued_csv(lines, blocks, True), layout,
                                quote, time_patterns, on_malformed, delimiter)
        still_open = unfinished_records(lines, blocks, True, True)
        return records, _advance(state, blocks, True, still_open)
    return Follower("\n", step)


def follow_rules(ruleset: RuleSet, on_malformed: str = "drop") -> Follower:
    """Without an end rule the last record stays open until the next one starts."""
    _check_policy(on_malformed)
    if ruleset.start_lines > 1:
        raise ValueError("a followed source may end inside of a start; starts have to lie in one line")

    def step(units, state):
        # What is still open is known to begin with a start and to have no end.
        still = _carried(units, state).withColumns({"start": F.lit(True), "close": F.lit(False)})
        lines = rules.mark_lines(units, ruleset).unionByName(still)
        blocks = index_blocks(lines, quoted=False, header=False, origin=state, hold_open=True)
        glued = glue_records(lines, blocks, False, False)
        still_open = unfinished_records(lines, blocks, False, False)
        return (rules.parse_rules(rules.cut_records(glued, ruleset), ruleset, on_malformed),
                _advance(state, blocks, False, still_open))
    return Follower("\n", step)


def _batch_path(root: str, kind: str, batch_id: int) -> str:
    return f"{root}/{kind}/batch_id={batch_id}"


def _state_before(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    if batch_id == 0:
        return spark.createDataFrame([], STATE_SCHEMA)
    return spark.read.schema(STATE_SCHEMA).parquet(_batch_path(root, "state", batch_id - 1))


def write_records(units: DataFrame, follower: Follower, out: str,
                  transform: Callable[[DataFrame], DataFrame] | None = None) -> DataStreamWriter:
    """Stream writer that appends the records of each micro-batch below ``out/records``.

    ``transform`` may filter or reshape records before they are written. The caller adds the
    checkpoint location and the trigger, and starts the query.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        try:
            with scratch.passing():
                state = _restart_replaced(rows, _state_before(spark, out, batch_id))
                records, after = follower.step(rows, scratch.write_table(state, "state"))
                records = transform(records) if transform else records
                records.write.mode("overwrite").parquet(_batch_path(out, "records", batch_id))
                after.write.mode("overwrite").parquet(_batch_path(out, "state", batch_id))
            scratch.remove_folder(spark, _batch_path(out, "state", batch_id - 2))
        finally:
            rows.unpersist()

    return units.writeStream.foreachBatch(write)


def read_written(spark: SparkSession, out: str, kind: str = "records") -> DataFrame:
    """What a stream has written so far."""
    return spark.read.option("basePath", f"{out}/{kind}").parquet(f"{out}/{kind}").drop("batch_id")


_VIEW_STATE = "source string, shown bigint"


def write_filtered_view(records: DataFrame, condition, out: str,
                        bucket: int = BUCKET) -> DataStreamWriter:
    """Growing filtered view: matches of a record stream get ``local_idx`` per source, going on
    from the count after the micro-batch before."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(condition).persist()
        try:
            before = (spark.createDataFrame([], _VIEW_STATE) if batch_id == 0 else
                      spark.read.schema(_VIEW_STATE).parquet(
                          _batch_path(out, "shown", batch_id - 1)))
            hits = dense_number(rows, ["source"], "local_idx", bucket=bucket)
            hits = (join_small(hits, before, "source")
                    .withColumn("local_idx", F.col("local_idx") + F.coalesce("shown", F.lit(0)))
                    .drop("shown"))
            hits.write.mode("overwrite").parquet(_batch_path(out, "view", batch_id))
            added = rows.groupBy("source").agg(F.count("*").alias("shown"))
            (before.unionByName(added).groupBy("source").agg(F.sum("shown").alias("shown"))
             .write.mode("overwrite").parquet(_batch_path(out, "shown", batch_id)))
            scratch.remove_folder(spark, _batch_path(out, "shown", batch_id - 2))
        finally:
            rows.unpersist()

    return records.writeStream.foreachBatch(write)
