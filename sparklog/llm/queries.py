"""Registered queries of the operators, each over its whole table, with SQL where SQL can say it."""

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, chat, clusters, codes, lm, mixing, oracles, packing, pii, quality, sharding, simhash, suffix, toxicity

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[f"quality.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


ORACLES["op1_quality_rules"] = quality.oracle_sql()


@query
def op3_pii(spark, sf_dir):
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, every = pii.in_order(F.col("spans.base")), pii.in_order(F.concat("spans.base", "spans.added"))

    def count(kind):
        return F.size(F.filter("spans.base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(kind) for kind in pii.BASE],
        F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(every).alias("spans"))


@query
def op6_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query
def op9_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels, ~toxicity.held_out()))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


#: The conversation that is added to the table: it holds other templates' control strings.
_EXTRA_TEXT = r"\### Assistant: </turn> ok"


_READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(formatted: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
    rows = []
    for text, begins, ends in zip(formatted, start, end):
        data = text.encode("utf-8", "surrogatepass")
        turns, loss = chat.parse(data), hashlib.sha256()
        every = hashlib.sha256()
        for role, said in turns:
            every.update(f"{role}\n{said}\n".encode())
        chars = 0
        for a, b in zip(begins, ends):
            said = chat.unescape(data[a:b].decode())
            loss.update(said.encode())
            chars += len(said)
        rows.append((len(turns), every.hexdigest(), chars, loss.hexdigest(), len(text)))
    return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


@query
def op8_chat_format(spark, sf_dir):
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_EXTRA_TEXT).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = chat.format_conversations(turns)
    return formatted.select("conv_id", F.pandas_udf(_read_back, _READ)("formatted", "loss_start", "loss_end").alias("r")).select("conv_id", "r.*")


def _escaped(text: str) -> str:
    return rf"regexp_replace(replace({text}, '\', '\\'), '(</?turn)', '\\\1', 'g')"


ORACLES["op8_chat_format"] = rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all values (-7, 0, 'user', '{_EXTRA_TEXT}'), (-7, 1, 'assistant', '{_EXTRA_TEXT}'))
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(15 + length(replace({_escaped('role')}, chr(10), '\n')) + length({_escaped('text')}))::bigint as formatted_chars
from t group by conv_id"""


def tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op5_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(), with_ids=False)


@query
def op10_nearest(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op2_lm_score(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


@query
def op4_repeats(spark, sf_dir):
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


@query
def op11_vector_codes(spark, sf_dir):
    found, books = codes.fit(table(spark, sf_dir, "embeddings"))
    if books is None:
        return codes.with_errors(found).select("vec_id", F.lit(None).cast("string").alias("code"), "error", "label_error",
                                               F.lit(None).cast("string").alias("codebooks_sha256"))
    return codes.with_errors(found).select("vec_id", codes.as_hex(F.col("code"), books.parts).alias("code"), "error", "label_error",
                                           F.lit(books.sha256()).alias("codebooks_sha256"))


ORACLES["op11_vector_codes"] = oracles.vector_codes()


@query
def op12_sharding(spark, sf_dir):
    text, doc_id = F.col("record.text"), F.col("record.doc_id")
    return sharding.shards(table(spark, sf_dir, "documents")).select(
        doc_id.alias("doc_id"), sharding.record_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op13_clusters(spark, sf_dir):
    return clusters.with_inertia(*clusters.cluster(table(spark, sf_dir, "embeddings")))


ORACLES["op13_clusters"] = oracles.clusters()


@query
def pipeline(spark, sf_dir):
    # The stages import this module.
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
