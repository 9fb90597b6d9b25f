"""Toxicity by maximum-scoring segments of token log-odds.

Each token has the log-odds of toxic against clean text with an informative
Dirichlet prior (the prior follows the token's share of both classes), kept
only where its z-score is significant, in either direction; a token counts once for each document
that has it, as one text that repeats itself is one witness; every other token
costs a small amount.  Tokens are hashed into a fixed number of buckets, so
the model has a fixed size.  The linear-time scan of Ruzzo and Tompa then
finds *all* maximal-scoring segments of a document.

Calibration is by extreme values: under clean text the best segment score M of
n tokens follows P(M >= x) = 1 - exp(-K n exp(-lambda x)), where lambda solves
E[exp(lambda * token score)] = 1 and K is fitted to the best scores of clean
documents.  A segment is significant if it is expected less than ``alpha``
times in such a text.  The document's statistic is the extreme-value deviate
of its best segment plus those of its other significant ones, and a sigmoid
over documents that the model did not see (two halves) turns it into a
probability.

The fit uses at most about ``sample`` labelled documents of each class, chosen
by a hash of the id; scoring covers every row and whole texts.

Nulls count as empty texts; they have no segment and the score of a text
without evidence.  Rows with a null label are not learned from, an id with
several labels has the largest.  With no or one class to learn from no token
has evidence and the score is the share of label 1 (0 without labels).
Repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import add_fields, bounded_sample, held_out, load, one_text_each, saved
from tessera.llm.linear import fit_sigmoid, sigmoid

#: Documents of each class that the fit uses at most, about.
SAMPLE = 8000
BITS = 18
#: Weight of the prior in tokens, least z-score, and cost of a token without evidence.
PRIOR, LEAST_Z, GAP = 500.0, 3.0, 0.35
ALPHA = 0.05
#: A document's statistic stays between these, so that one extreme passage can't bend the sigmoid.
LEAST_DEVIATE, MOST_DEVIATE = -2.0, 12.0


def maximal_segments(scores: np.ndarray, cost: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score): Ruzzo and Tompa's linear-time scan.

    ``scores``: positive where there is evidence, negative where there is
    evidence against, 0 elsewhere; a 0 costs ``cost``.  Stretches without a
    positive score only lower the running total, so the scan visits positives
    alone.  Every open segment knows the nearest earlier one with a smaller
    total before it; what lies between is never looked at again.  When there
    is none, all open segments are final.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate(([0.0], np.cumsum(np.where(scores != 0, scores, -cost))))
    final: list[tuple] = []
    found: list[tuple] = []  # start, end, total before, total after, place of the nearest one with a smaller total before
    for start, left, right in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist(), strict=True):
        end, j = start + 1, len(found) - 1
        while j >= 0 and found[j][2] >= left:
            j = found[j][4]
        while j >= 0 and found[j][3] < right:
            start, _, left, _, before = found[j]
            del found[j:]
            j = before
        if j < 0:
            final += found
            found.clear()
        found.append((start, end, left, right, j))
    return [(a, b, float(r - l)) for a, b, l, r, _ in final + found]


@dataclass
class Model:
    """Token scores by bucket and what turns segment scores into a probability."""

    token: np.ndarray
    lam: float = 1.0
    k: float = 0.1
    slope: float = 0.0
    shift: float = 0.0
    alpha: float = ALPHA
    bits: int = field(default=BITS)

    def segments(self, hashes: np.ndarray) -> list[tuple[int, int, float, float]]:
        """(start, end, score, expected number by chance) of each maximal segment, in tokens."""
        n = max(1, len(hashes))
        return [(a, b, s, self.k * n * float(np.exp(-self.lam * s))) for a, b, s in maximal_segments(self.token[hashes >> W.U64(64 - self.bits)], GAP)]

    def statistic(self, segments: list[tuple[int, int, float, float]]) -> float:
        deviates = sorted((-np.log(max(e, 1e-300)) for *_, e in segments), reverse=True)
        if not deviates:
            return LEAST_DEVIATE
        bar = -np.log(self.alpha)
        total = deviates[0] + sum(d - bar for d in deviates[1:] if d > bar)
        return float(np.clip(total, LEAST_DEVIATE, MOST_DEVIATE))

    def score(self, statistic: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * statistic + self.shift)


@dataclass
class Counts:
    """Documents that hold a token of a bucket, by class, for the buckets that may score; ``n``: sums over all buckets."""

    bucket: np.ndarray
    toxic: np.ndarray
    clean: np.ndarray
    n_toxic: float
    n_clean: float

    def odds(self) -> np.ndarray:
        """Token scores with the informative Dirichlet prior; 0 where not significant."""
        share = PRIOR / (self.n_toxic + self.n_clean + 0.01 * (1 << BITS))
        prior = share * (self.toxic + self.clean + 0.01)
        y1, y0 = self.toxic + prior, self.clean + prior
        odds = np.log(y1 / (self.n_toxic + PRIOR - y1)) - np.log(y0 / (self.n_clean + PRIOR - y0))
        z = odds / np.sqrt(1 / y1 + 1 / y0)
        return np.where((np.abs(z) >= LEAST_Z) & (np.abs(odds) > GAP), odds, 0.0)

    def model(self) -> Model:
        token = np.zeros(1 << BITS, np.float32)
        odds = self.odds()
        token[self.bucket] = odds
        return Model(token, lam=self._lambda(odds))

    def _lambda(self, odds: np.ndarray) -> float:
        """The positive root of E[exp(lambda * score)] = 1 under clean text."""
        scored = odds != 0
        mass = (self.clean[scored] + 1e-3) / max(self.n_clean, 1.0)
        value, rest = odds[scored], max(0.0, 1.0 - float(mass.sum()))
        excess = lambda x: float((mass * np.exp(np.minimum(x * value, 500))).sum()) + rest * np.exp(-x * GAP) - 1
        if not (odds > 0).any() or float((mass * value).sum()) - rest * GAP >= 0:
            return 1.0
        low, high = 1e-6, 1.0
        while excess(high) < 0 and high < 64:
            high *= 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if excess(mid) < 0 else (low, mid)
        return high


def _fit_k(model: Model, best: np.ndarray, n: np.ndarray) -> float:
    """K from clean documents: the expected best score is (ln(K n) + 0.5772) / lambda."""
    keep = best > 0
    if keep.sum() < 5:
        return 0.1
    # P(no positive segment) = exp(-K n): documents without one count through their share.
    log_k = np.median(model.lam * best[keep] - 0.5772 - np.log(np.maximum(n[keep], 1)))
    return float(np.clip(np.exp(log_k) * keep.mean(), 1e-6, 1.0))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The calibrated model from a bounded sample of labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    chosen, by_class = bounded_sample(known, "y", "doc_id", sample)
    chosen = chosen.withColumn("half", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)).cast("int"))
    total = sum(by_class.values())
    if not by_class.get(0) or not by_class.get(1):
        share = (by_class.get(1, 0) + 0.5) / (total + 1.0) if total else 1e-6
        return Model(np.zeros(1 << BITS, np.float32), shift=float(np.log(share / (1 - share))))
    # The sampled labels, about two times ``sample`` rows of 16 bytes, are what is broadcast.
    found = one_text_each(docs, chosen).select("y", "half", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            group = b.column(0).to_numpy() * 2 + b.column(1).to_numpy()
            for a, z, words in W.tokens(b.column(2), W.LETTERS_AND_MARKS):
                row = np.repeat(np.arange(len(words)), np.diff(words.offsets))
                once = np.unique(row << BITS | (words.hashes >> W.U64(64 - BITS)).astype(np.int64))
                owner, bucket = group[a:z][once >> BITS], once & ((1 << BITS) - 1)
                for g in np.unique(owner):
                    sums[int(g)] = sums.get(int(g), 0) + np.bincount(bucket[owner == g], minlength=1 << BITS)
        for g, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["g", "bucket", "n"])

    part = lambda y, half: F.sum(F.when(F.col("g") == 2 * y + half, F.col("n")).otherwise(0)).alias(f"y{y}h{half}")
    names = [f"y{y}h{h}" for y in (0, 1) for h in (0, 1)]
    table = saved(found.mapInArrow(count, "g int, bucket int, n bigint").groupBy("bucket").agg(*(part(y, h) for y in (0, 1) for h in (0, 1))))
    n = {k: float(v or 0) for k, v in table.agg(*(F.sum(c).alias(c) for c in names)).first().asDict().items()}
    # Only buckets that lean to toxic or to clean text in either half can score; the bar is far below the one that counts.
    leaning = F.lit(False)
    for halves in ((0,), (1,), (0, 1)):
        y1, y0 = (sum((F.col(f"y{y}h{h}") for h in halves), F.lit(0.5)) for y in (1, 0))
        n1, n0 = (max(1.0, sum(n[f"y{y}h{h}"] for h in halves)) for y in (1, 0))
        leaning = leaning | (F.abs(F.log(y1 / n1) - F.log(y0 / n0)) / F.sqrt(1 / y1 + 1 / y0) > LEAST_Z / 2)
    rows = table.where(leaning).orderBy("bucket").toPandas()

    def counts(halves: tuple[int, ...]) -> Counts:
        y1, y0 = (sum(rows[f"y{y}h{h}"].to_numpy(float) for h in halves) for y in (1, 0))
        return Counts(rows["bucket"].to_numpy(), y1, y0, *(sum(n[f"y{y}h{h}"] for h in halves) for y in (1, 0)))

    models = [counts((1 - h,)).model() for h in (0, 1)]  # models[h] has not seen half h
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, half, out = b.column(0).to_numpy(), b.column(1).to_numpy(), []
            for a, _, words in W.tokens(b.column(2), W.LETTERS_AND_MARKS):
                for i in range(len(words)):
                    h = words.hashes[words.offsets[i] : words.offsets[i + 1]]
                    out.append((int(label[a + i]), int(half[a + i]), len(h), [s for *_, s, _ in sent.value[half[a + i]].segments(h)]))
            yield pa.RecordBatch.from_pylist([dict(zip(("y", "half", "n", "found"), x)) for x in out], schema=pa.schema([("y", pa.int32()), ("half", pa.int32()), ("n", pa.int64()), ("found", pa.list_(pa.float64()))]))

    seen = found.mapInArrow(measure, "y int, half int, n bigint, found array<double>").toPandas()
    best = np.array([max(x, default=0.0) for x in seen["found"]])
    y, half, size = (seen[c].to_numpy() for c in ("y", "half", "n"))
    statistic = np.zeros(len(seen))
    for h in (0, 1):
        models[h].k = _fit_k(models[h], best[(half == h) & (y == 0)], size[(half == h) & (y == 0)])
    for i, x in enumerate(seen["found"]):
        m = models[half[i]]
        statistic[i] = m.statistic([(0, 0, s, m.k * max(1, size[i]) * float(np.exp(-m.lam * s))) for s in x])
    final = counts((0, 1)).model()
    final.k = float(np.sqrt(models[0].k * models[1].k))
    drawn = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.where(y == 1, by_class[1] / drawn[1], by_class[0] / drawn[0])
    final.slope, final.shift = fit_sigmoid(statistic, y, weight * len(y) / weight.sum())
    return final


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``toxic_passages`` (start and end word, score of significant segments)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    @F.arrow_udf("struct<toxicity:double,toxic_passages:array<struct<start:bigint,end:bigint,score:double>>>")
    def measure(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        for col in texts:
            values, passages = [], []
            for _, _, words in W.tokens(col, W.LETTERS_AND_MARKS):
                for i in range(len(words)):
                    segments = m.segments(words.hashes[words.offsets[i] : words.offsets[i + 1]])
                    values.append(m.statistic(segments))
                    passages.append([{"start": a, "end": b, "score": s} for a, b, s, e in segments if e < m.alpha])
            yield pa.StructArray.from_arrays([pa.array(m.score(np.array(values, dtype=float)), pa.float64()), pa.array(passages, passage)], ["toxicity", "toxic_passages"])

    return add_fields(docs, measure(F.col(text)), ("toxicity", "toxic_passages"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every whole text of ``documents``."""
    docs = load(spark, sf_dir, "documents")
    scored = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, load(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), F.size("toxic_passages").cast("long").alias("n_passages"))
