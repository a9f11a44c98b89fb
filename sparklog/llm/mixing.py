"""Mixing sources to target weights by Sainte-Lague apportionment.

A mix is made of blocks of equally many words. Sources get whole numbers of blocks by the
highest quotients ``votes / (2 * seats + 1)``; so do, within a source, its shards, which are
parts of bounded size. In a shard the documents lie in a seeded order, and the mix takes its quota
of consecutive blocks from a seeded start, around the end if need be: whole documents, but for the
two at the ends. Quotas above all blocks of a shard take all of them once more.

Only narrow rows (an id, a source, a size) are shuffled; a source that owns any share of the rows
is as many shards as its size needs, and no window holds more than a shard's documents or a
source's shards.

Defined results: a null text has no words, a null source is a source of its own and comes last,
documents without words are never taken, repeated rows are documents of their own (rows alike in
id and size share the same places in any order), and an empty table gives an empty one. Columns
other than the three inputs are not read.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import scratch
from .text import SPACE, WORD, whole, word_count

#: Weights of the sources in order, repeating. Fixed values.
WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """One row per source of ``sizes`` (source, size): its ``source_size`` and ``target``.

    All targets are ``level * weight`` up to ``most`` times the source's size. Sources in the order
    of the level at which they are full: the first that is not full there gives the level.
    The rows are one per source, added up before they meet; sources are few against documents.
    """
    by_code = W.orderBy(F.col("source").isNull(), F.col("source"))
    full_order = W.orderBy("_full", "_rank")
    rows = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
            .withColumn("_rank", F.row_number().over(by_code))
            .withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
            .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
            .withColumn("_full", F.col("_cap") / F.col("_weight"))
            .withColumn("_total", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))))
    before = full_order.rowsBetween(W.unboundedPreceding, -1)
    after = full_order.rowsBetween(0, W.unboundedFollowing)
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(after)
    rows = rows.withColumn("_level", level)
    # The first source that is not full at its level has the highest such level.
    found = F.max(F.when(F.col("_level") <= F.col("_full"), F.col("_level"))).over(W.partitionBy())
    return rows.select("source", "source_size", F.least(F.col("_cap"), F.col("_weight") * F.coalesce(found, F.col("_full"))).alias("target"))


def apportion(parties: DataFrame, group: list[str], party: list[str], votes: str, seats: str, cap: str) -> DataFrame:
    """``parties`` with ``quota``: the ``seats`` of each group dealt by highest quotients.

    ``seats`` is the same for all rows of a group; no party gets more than ``cap``. Instead of
    dealing seats one by one, bounds of the divisor give each party seats that it has for certain,
    and only the few beyond compete: their number is in proportion to the parties.
    """
    w = W.partitionBy(*group)
    rows = (parties.withColumn("_v", F.sum(votes).over(w)).withColumn("_p", F.count(F.lit(1)).over(w))
            .withColumn("_spare", F.col(seats) - F.col("_p") / 2 - 1)
            .withColumn("_sure", F.when((F.col("_spare") > 0) & (F.col("_v") > 0), F.least(
                F.floor(F.col(votes) / F.col("_v") * F.col("_spare") + 0.5), F.col(cap))).otherwise(0).cast("long"))
            .withColumn("_sure", F.greatest(F.col("_sure") - 1, F.lit(0)))
            .withColumn("_upto", F.when(F.col("_v") > 0, F.least(
                F.ceil(F.col(votes) / F.col("_v") * (F.col(seats) + F.col("_p") / 2 + 1) + 1), F.col(cap))).otherwise(0).cast("long"))
            .withColumn("_left", F.col(seats) - F.sum("_sure").over(w)))
    rival = (rows.where("_upto > _sure").select(*group, *party, "_left", F.col(votes).alias("_votes"),
                                                F.explode(F.sequence("_sure", F.col("_upto") - 1)).alias("_seat"))
             .withColumn("_q", F.col("_votes") / (2 * F.col("_seat") + 1))
             .withColumn("_n", F.row_number().over(w.orderBy(F.desc("_q"), F.desc("_votes"), *party, "_seat")))
             .where("_n <= _left").groupBy(*group, *party).agg(F.count(F.lit(1)).alias("_won")))
    joined = rows.drop("_v", "_p", "_spare", "_upto", "_left")
    won = rival.select(*[F.col(k).alias(f"_r_{k}") for k in (*group, *party)], "_won")
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in (*group, *party)]
    return (joined.join(won, on, "left")
            .withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0)))
            .drop("_sure", "_won", *[f"_r_{k}" for k in (*group, *party)]))


def words_taken(at: Column, blocks: Column, quota: Column, start: Column, block: int) -> Column:
    """Words that the mix takes of the first ``at`` words of a shard of ``blocks`` blocks.

    All blocks are taken ``quota div blocks`` times, and ``quota mod blocks`` of them, from block
    ``start`` on and around the end, once more.
    """
    rest = quota % blocks
    end = start + rest
    def overlap(a, b):
        return F.greatest(F.lit(0), F.least(at, b * block) - F.least(at, a * block))
    return (F.floor(quota / blocks) * at + overlap(start, F.least(end, blocks))
            + overlap(F.lit(0), F.greatest(end - blocks, F.lit(0)))).cast("long")


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, block: int = 64,
        shard_words: int = 1_000_000, seed: int = 7) -> DataFrame:
    """One row per document of ``docs`` (doc_id, source, text): ``doc_id``, ``source``, ``size``,
    ``source_size``, ``target``, ``taken``."""
    sizes = scratch.write_table(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(whole("text")).alias("size")), "mix-sizes")
    return take(sizes, share, most, block, shard_words, seed)


def take(sizes: DataFrame, share: float, most: float, block: int, shard_words: int, seed: int) -> DataFrame:
    per_source = targets(sizes, share, most).withColumn(
        "_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    # A row per source: the join is a broadcast while Spark measures it small, else a join whose
    # large keys Spark splits.
    source = per_source.select(F.col("source").alias("_s"), "source_size", "target", "_shards")
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    placed = (sizes.join(source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
              .withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("size")), F.col("_shards"))))
    shards = (placed.groupBy("source", "_shard").agg(
        F.sum("size").alias("_words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
        .withColumn("_blocks", F.greatest(F.lit(1), F.ceil(F.col("_words") / block)).cast("long")))
    # Seats of a source: apportioned among sources first, then within each source to its shards.
    seats = (shards.groupBy("source").agg(F.first("target").alias("target"), F.sum("_blocks").alias("_all"))
             .withColumn("_one", F.lit(0)).withColumn("_cap", F.floor(2 * F.col("_all")).cast("long")))
    seats = seats.withColumn("_seats", F.round(F.sum("target").over(W.partitionBy("_one")) / block).cast("long"))
    seats = apportion(seats, ["_one"], ["source"], "target", "_seats", "_cap").select(F.col("source").alias("_s"), F.col("quota").alias("_seats"))
    parts = shards.join(seats, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_cap", 2 * F.col("_blocks"))
    quotas = apportion(parts, ["source"], ["_shard"], "_words", "_seats", "_cap").select(
        F.col("source").alias("_s"), F.col("_shard").alias("_h"), "_blocks", "quota",
        F.pmod(F.xxhash64(F.lit(seed + 2), F.col("source"), F.col("_shard")), F.col("_blocks")).alias("_start"))
    by_shard = W.partitionBy("source", "_shard").orderBy(order, "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    laid = placed.withColumn("_end", F.sum("size").over(by_shard))
    joined = laid.join(quotas, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_h")))
    upto = lambda at: words_taken(at, F.col("_blocks"), F.col("quota"), F.col("_start"), block)
    begin = F.col("_end") - F.col("size")
    return joined.select("doc_id", "source", "size", "source_size", "target",
                         (upto(F.col("_end")) - upto(begin)).alias("taken"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix has them: the text holds the words taken, so often as they are taken, and
    documents of which nothing is taken are gone. A part of a document is its first words, with the
    white space between them; copies are joined by a line break. ``n_chars`` follows the text; other columns, of any
    name, stay as they are."""
    taken = mix(docs, **options).groupBy("doc_id", "size", "source").agg(F.max("taken").alias("taken")).select(
        F.col("doc_id").alias("taken_id"), F.col("source").alias("taken_source"), F.col("size").alias("taken_size"), "taken")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.col("doc_id").cast("long").alias("own_id"),
                       F.col("source").cast("string").alias("own_source"), whole("text").alias("whole"))
    joined = rows.withColumn("size", word_count(F.col("whole"))).join(
        taken, F.col("own_id").eqNullSafe(F.col("taken_id")) & F.col("own_source").eqNullSafe(F.col("taken_source")) & (F.col("size") == F.col("taken_size")))
    copies = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = (F.col("taken") % F.col("size")).cast("int")
    # Each piece ends where a word ends.
    pieces = F.split("whole", rf"(?<={WORD})(?={SPACE})")
    part = F.array_join(F.slice(pieces, F.lit(1), rest), "")
    text = F.array_join(F.concat(F.array_repeat("whole", copies), F.when(rest > 0, F.array(part)).otherwise(F.array().cast("array<string>"))), "\n")
    out = joined.where("taken > 0").withColumn("mixed", text)
    changed = {"text": F.col("mixed")} | ({"n_chars": F.length("mixed").cast("long")} if "n_chars" in docs.columns else {})
    return out.select(*[changed.get(c, F.col("record")[c]).alias(c) for c in docs.columns])
