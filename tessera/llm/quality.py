"""Quality classifier: a linear support vector machine on naive Bayes features.

A document's features are indicators of its word 1- and 2-grams, hashed into a
fixed number of buckets; runs of letters and runs of marks are words.  2-grams
of a word with itself, and words that occur again, also count as such: their
shares pass some of a row of steps, each step an indicator.  Each indicator
is scaled by its class log-count ratio, the feature vector has unit length,
and a linear hinge-loss model is fitted by dual coordinate descent.  The margin of documents that a model did not see (two halves, each
scored by the other's model) gives the probability by a sigmoid.

The fit uses at most about ``sample`` labelled documents of each class, chosen
by a hash of the id, so the model and the data it comes from have a fixed
size; scoring covers every row.

Nulls count as empty texts, which score like a text without a known feature.
Rows with a null label are not learned from.  If an id has several labels the
largest counts.  With no or one class to learn from every score is the share
of label 1 (0.5 without labels).  Repeated rows get equal scores; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import bounded_sample, held_out, load, one_text_each
from tessera.llm.linear import fit_hinge, fit_sigmoid, sigmoid

#: Documents of each class that the fit uses at most, about; one holds some 2 kB of features.
SAMPLE = 3000
BITS = 18
#: Steps of a document's share of words that repeat the word before them, and of words it has had before.
STEPS = (0.005, 0.01, 0.02, 0.04, 0.08, 0.12, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def features(col: pa.Array, bits: int = BITS) -> Iterator[np.ndarray]:
    """The sorted distinct feature numbers of each text."""
    steps, reserved = np.array(STEPS), (1 << bits) - 2 * len(STEPS)
    for _, _, words in W.tokens(col, W.LETTERS_AND_MARKS):
        pairs = W.grams(words, 2)
        one, two = words.hashes >> W.U64(64 - bits), pairs.hashes >> W.U64(64 - bits)
        again = np.concatenate(([0], np.cumsum(words.hashes[1:] == words.hashes[:-1]), [0]))
        for i in range(len(words)):
            a, b = words.offsets[i], words.offsets[i + 1]
            own = np.unique(words.hashes[a:b])
            repeats = (again[b - 1] - again[a]) / (b - a) if b > a else 0.0
            known = 1 - len(own) / (b - a) if b > a else 0.0
            passed = np.concatenate((np.flatnonzero(repeats >= steps), len(STEPS) + np.flatnonzero(known >= steps))).astype(np.uint64) + W.U64(reserved)
            yield np.unique(np.concatenate((one[a:b], two[pairs.offsets[i] : pairs.offsets[i + 1]], passed))).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray  # class log-count ratio times hinge weight
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(rows))
        for i, at in enumerate(rows):
            r = self.ratios[at]
            out[i] = self.weights[at].sum() / (np.sqrt(r @ r) or 1.0) + self.bias
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return sigmoid(self.slope * self.margins(rows) + self.shift)


def _fit(rows: list[np.ndarray], label: np.ndarray, bits: int) -> Model:
    size = 1 << bits
    counts = np.ones((2, size))
    for at, y in zip(rows, label, strict=True):
        counts[y, at] += 1
    n = np.array([max(1, (label == 0).sum()), max(1, (label == 1).sum())])
    # The ratio of document shares: with so few documents for so many features, dividing by the
    # sum over features would shift every ratio by the same amount.
    ratio = np.log(counts[1] / (n[1] + 2)) - np.log(counts[0] / (n[0] + 2))
    ratio[(counts[0] == 1) & (counts[1] == 1)] = 0.0
    scaled = []
    for at in rows:
        r = ratio[at]
        scaled.append((at, r / (np.sqrt(r @ r) or 1.0)))
    balance = len(rows) / (2.0 * n)
    w = fit_hinge(scaled, np.where(label == 1, 1, -1), size, cost=1.0, class_weights=tuple(balance))
    return Model((w[:-1] * ratio).astype(np.float32), ratio.astype(np.float32), float(w[-1]), 1.0, 0.0)


def fit_model(rows: list[np.ndarray], label: np.ndarray, half: np.ndarray, counts: dict[int, int], bits: int = BITS) -> Model:
    """The model, its sigmoid fitted to margins of the half that each of two half models did not see."""
    total = sum(counts.values())
    if len(set(label)) < 2:
        share = (counts.get(1, 0) + 0.5) / (total + 1.0)
        return Model(np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    margins = np.zeros(len(rows))
    for h in (0, 1):
        seen = np.flatnonzero(half != h)
        if len(set(label[seen])) < 2:
            seen = np.arange(len(rows))
        unseen = np.flatnonzero(half == h)
        margins[unseen] = _fit([rows[i] for i in seen], label[seen], bits).margins([rows[i] for i in unseen])
    drawn = {c: max(1, int((label == c).sum())) for c in (0, 1)}
    weight = np.where(label == 1, counts[1] / drawn[1], counts[0] / drawn[0])
    model = _fit(rows, label, bits)
    model.slope, model.shift = fit_sigmoid(margins, label, weight * len(label) / weight.sum())
    return model


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, sample: int, feature_fn) -> tuple[pd.DataFrame, dict]:
    """Features of a bounded sample of the labelled training rows.

    The sampled labels (12 bytes a row, two times ``sample`` rows about) are
    what is broadcast, so the documents are read once and not shuffled.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen, counts = bounded_sample(known, "y", "doc_id", sample)
    chosen = chosen.withColumn("half", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)).cast("int"))
    found = one_text_each(docs, chosen).select("y", "half", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([at.tobytes() for at in feature_fn(b.column(2))], pa.binary())], ["y", "half", "features"])

    rows = found.mapInArrow(extract, "y int, half int, features binary").toPandas()
    rows = rows.sort_values(["y", "half", "features"], kind="stable").reset_index(drop=True)
    return rows, counts


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``."""
    rows, counts = labelled_features(docs, labels, "quality", sample, features)
    at = [np.frombuffer(x, np.int32) for x in rows["features"]]
    model = fit_model(at, rows["y"].to_numpy(np.int64), rows["half"].to_numpy(), counts)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sent.value.scores(list(features(b.column(2)))), pa.float64())], ["doc_id", "held_out", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(score, f"doc_id {id_type}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every whole text of ``documents``."""
    return quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
