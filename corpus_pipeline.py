"""Documents to training sequences: five operators one after another.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; its result is written as
Parquet and read again. All but the last return the columns of ``documents``:

* ``toxicity`` drops documents that the classifier rejects. It learns from the table ``labels`` and the stage's own
  documents.
* ``near_duplicates`` keeps one document of each component, the one of the smallest id. Links are pairs of SimHash
  fingerprints of three-word shingles that differ in two bits at most, as in the operator's own query.
* ``personal_data`` replaces each span by its kind in brackets.
* ``mixing`` makes the text of each document the words that the mix takes of it, so often as it takes them, and
  drops those of which it takes nothing.
* ``packing`` packs the texts into sequences of 1,024 tokens.

The other stages have the parameters of the operators' own queries. ``n_chars`` follows the text.
"""

from pyspark.sql import DataFrame, SparkSession

from sparklog import scratch
from sparklog.llm import mixing, packing, pii, simhash, toxicity
from sparklog.llm.queries import table, tokenizer

#: SQL can't express the classifier, the components or the tokenizer: the stages are tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs, shingle=3, limit=2)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
