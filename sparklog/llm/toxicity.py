"""Toxicity: a linear classifier with counterfactual regularisation.

Features are the distinct words of a text and the beginnings of longer words. A model is fitted to a
bounded sample of labelled rows: the features whose presence goes with the label most clearly are
chosen by their counts over that sample, then weights are found by gradient descent on the logistic
loss. Every labelled text that names a group gets a twin in which the group's name is swapped for
another one's; the squared difference of the two scores is part of the loss, so a score may not rest
on which group is named. Scores depend on the text alone.

Bounds: ``sample_rows`` labelled rows (those of the smallest hashes of their ids) and ``features``
chosen features. The sample of ids is broadcast, and what reaches the driver is at most that many
rows of at most ``features`` numbers each. Scoring covers every row and shuffles nothing.

Defined results: null and empty texts get the score of no feature at all; repeated rows get the same
score; labels without a text, null labels and null ids don't count; a row labelled more than once is
toxic if one label says so; without any labels all scores are 0.5 - 1e-9; other columns stay, those named
as the added ones are replaced; an empty table gives an empty table.
"""

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .. import scratch

#: Names of groups, each row interchangeable in a sentence. Fixed values.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "elderly"), ("blind", "deaf", "disabled"),
    ("frauen", "männer"), ("christen", "muslime", "juden"), ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs"), ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos"),
)
_NEXT = {w: row[(i + 1) % len(row)] for row in IDENTITY for i, w in enumerate(row)}
_WORDS = re.compile(r"[^\W_]+")
_STARTS = (4, 5, 6)


def features_of(words: set[str]) -> set[str]:
    """The words, and their beginnings marked by a caret."""
    return words.union("^" + w[:n] for w in words for n in _STARTS if len(w) > n)


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall((text or "").lower()))


def swapped(words: set[str]) -> set[str] | None:
    """The words with every group's name exchanged, or nothing if no group is named."""
    named = words & _NEXT.keys()
    return (words - named) | {_NEXT[w] for w in named} if named else None


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4e-9


def logit(text: str | None, weights: dict[str, float], bias: float) -> float:
    # Summed in a fixed order, so that equal texts get equal scores everywhere.
    return bias + sum(sorted(weights[f] for f in features_of(words_of(text)) if f in weights))


def sample_of(labels: DataFrame, sample_rows: int, learn) -> DataFrame:
    """The bounded sample of labels (doc_id, toxic), of rows for which ``learn`` holds."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn)
    return (usable.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))


def _distinct_words(batches):
    for batch in batches:
        words = [words_of(t) for t in batch.column(1).to_pylist()]
        twins = [swapped(w) for w in words]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([sorted(w) for w in words], pa.list_(pa.string())),
            pa.array([None if t is None else sorted(t) for t in twins], pa.list_(pa.string()))], ["toxic", "words", "twin"])


def _count_features(batches):
    """Texts and toxic texts that have each feature, added up per batch."""
    for batch in batches:
        n, toxic = Counter(), Counter()
        for label, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = features_of(set(words))
            n.update(found)
            if label:
                toxic.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()),
                                          pa.array([toxic[f] for f in n], pa.int64())], ["f", "n", "t"])


def fit(docs: DataFrame, labels: DataFrame, learn=None, sample_rows: int = 30_000, features: int = 4_096,
        least_rows: int = 4, penalty: float = 0.1) -> Model:
    """``docs`` (doc_id, text), ``labels`` (doc_id, toxic); ``learn`` is a condition on doc_id."""
    sample = sample_of(labels, sample_rows, F.lit(True) if learn is None else learn)
    # At most sample_rows ids and flags.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = scratch.write_table(rows.select("toxic", "text").mapInArrow(
        _distinct_words, "toxic boolean, words array<string>, twin array<string>"), "toxicity-sample")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0)).alias("t")).first()
    if not total["t"] or total["t"] == total["n"]:
        return Model()
    counts = rows.select("toxic", "words").mapInArrow(_count_features, "f string, n long, t long").groupBy("f").agg(
        F.sum("n").alias("n"), F.sum("t").alias("t")).where(F.col("n") >= least_rows)
    # Evidence against independence, in units of its spread.
    expected = F.col("n") * (total["t"] / total["n"])
    evidence = F.abs(F.col("t") - expected) / F.sqrt(expected * (1 - F.col("n") / F.lit(float(total["n"] + 1))))
    chosen = [r["f"] for r in counts.orderBy(F.desc(evidence), "f").limit(features).select("f").collect()]
    place = {f: i for i, f in enumerate(chosen)}

    def encode(batches):
        for batch in batches:
            def ids(words):
                return None if words is None else sorted(place[f] for f in features_of(set(words)) if f in place)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([ids(w) for w in batch.column(1).to_pylist()], pa.list_(pa.int32())),
                pa.array([ids(w) for w in batch.column(2).to_pylist()], pa.list_(pa.int32()))], ["toxic", "x", "twin"])

    coded = rows.mapInArrow(encode, "toxic boolean, x array<int>, twin array<int>").toArrow()
    weights, bias = train(coded.column("toxic").to_pylist(), coded.column("x").to_pylist(), coded.column("twin").to_pylist(), len(chosen), penalty)
    return Model({f: float(w) for f, w in zip(chosen, weights) if abs(w) > 1e-6}, float(bias))


def _rows(lists):
    lengths = np.array([len(x) for x in lists], np.int64)
    return np.repeat(np.arange(len(lists)), lengths), np.array([i for x in lists for i in x], np.int64)


def train(toxic, x, twins, n_features: int, penalty: float, rounds: int = 300, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the mean logistic loss, plus ``penalty`` times the mean squared
    difference of the log odds of twins, plus ``decay`` times the squared weights."""
    # Rows in a fixed order, so that reruns add alike.
    order = sorted(range(len(x)), key=lambda i: (bool(toxic[i]), x[i], twins[i] or []))
    y = np.array([bool(toxic[i]) for i in order], float)
    x, twins = [x[i] for i in order], [twins[i] for i in order]
    row, col = _rows(x)
    has = np.array([i for i, t in enumerate(twins) if t is not None], np.int64)
    twin_row, twin_col = _rows([twins[i] for i in has])
    n = len(x)
    # Classes weigh alike up to a factor of 3, so that the rarer one is not left out.
    weight = np.where(y > 0, min(3.0, max(1.0, (1 - y.mean()) / y.mean())), 1.0)
    weight /= weight.sum()
    w, bias = np.zeros(n_features), 0.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for k in range(1, rounds + 1):
        z = bias + np.bincount(row, w[col], n)
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        slope = weight * (p - y)
        grad = np.zeros(n_features)
        if len(has):
            pull = 2 * penalty / len(has) * (z[has] - bias - np.bincount(twin_row, w[twin_col], len(has)))
            grad += np.bincount(col, np.bincount(has, pull, n)[row], n_features) - np.bincount(twin_col, pull[twin_row], n_features)
        grad += np.bincount(col, slope[row], n_features) + 2 * decay * w
        grad = np.append(grad, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.1 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` from 0 to 1 and ``predicted``, 1 at 0.5 or more."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        z = np.array([logit(t, *shared.value) for t in texts], float)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -50, 50))))

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*kept, of(F.col(f"`{text}`")).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def held_out(parts: int = 5):
    """The condition on doc_id that leaves a row out of learning; a null id is left out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == 0, F.lit(True))


def reject_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without those that the classifier calls toxic; their columns, of any name, stay as they are."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), "text")
    return score(rows, fit(docs, labels, ~held_out(), **options)).where("predicted = 0").select("record.*")
