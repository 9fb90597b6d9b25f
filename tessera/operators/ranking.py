"""Rank fusion, diversity and calibration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the fused score, and when the ranking abstains.
FUSED = {"rrf": 0.50, "quality": 0.14, "freshness": 0.14, "applicability": 0.10, "precedent": 0.07, "identity": 0.05, "negative": -0.05}
LEAST_SCORE, LEAST_MARGIN, LEAST_CONFIDENCE = 0.35, 0.02, 0.55
RRF_K = 60


def reciprocal_rank_fusion(arms: DataFrame, k: int = RRF_K) -> DataFrame:
    """``id, rrf`` from ``arms(id, arm, rank, weight)``: the sum of weight / (k + rank), over its greatest possible value."""
    most = arms.select("arm", "weight").distinct().agg(F.sum(F.col("weight") / (k + 1)).alias("most"))
    return arms.groupBy("id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("raw")).join(F.broadcast(most)).select("id", (F.col("raw") / F.col("most")).alias("rrf"))


def fused_score(signals: dict[str, Column]) -> Column:
    return sum((F.lit(w) * F.coalesce(signals[name], F.lit(0.0)) for name, w in FUSED.items() if name in signals), F.lit(0.0))


def margin_and_abstain(scored: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of ``scored(id, score)`` with rank and clamped score; none if the first is unsure.

    The margin is taken before scores are clamped; a single row is its own
    margin.  Only the best ``k`` + 1 rows are ever ordered together.
    """
    top = scored.where(F.col("score") >= LEAST_SCORE).orderBy(F.desc("score"), "id").limit(k + 1)
    w = Window.orderBy(F.desc("score"), "id")
    ranked = top.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("score").over(w))
    first = ranked.where("rank = 1").select((F.col("score") - F.coalesce("next", F.lit(0.0))).alias("margin"), F.col("score").alias("best"))
    sure = (F.col("margin") >= LEAST_MARGIN) & (F.col("best") >= LEAST_CONFIDENCE)
    return ranked.where(F.col("rank") <= k).join(F.broadcast(first)).where(sure).select("id", "rank", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score"), "margin")


def mmr(candidates: DataFrame, n: int, weight: float = 0.7) -> DataFrame:
    """Greedy maximal marginal relevance within each ``query``: ``query, id, place``.

    ``candidates(query, id, distance, embedding)``: at most a few hundred
    rows of a query (the oversample), so a query is one group.  A null
    embedding is compared with nothing; ties go to the smaller distance, then
    id.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["distance", "id"]).reset_index(drop=True)
        relevance = 1 - np.clip(rows["distance"].to_numpy(float), 0, 2) / 2
        vectors = np.zeros((len(rows), max((len(v) for v in rows["embedding"] if v is not None), default=1)))
        for i, v in enumerate(rows["embedding"]):
            if v is not None:
                x = np.asarray(v, float)
                vectors[i] = x / (np.linalg.norm(x) or 1.0)
        near, open_, order = np.zeros(len(rows)), np.ones(len(rows), bool), []
        while len(order) < min(n, len(rows)):
            gain = np.where(open_, weight * relevance - (1 - weight) * (near if order else 0.0), -np.inf)
            i = int(np.argmax(gain))
            order.append(i)
            open_[i] = False
            near = np.maximum(near, vectors @ vectors[i]) if len(order) > 1 else vectors @ vectors[i]
        return pd.DataFrame({"query": rows["query"].iloc[order].to_numpy(), "id": rows["id"].iloc[order].to_numpy(), "place": np.arange(1, len(order) + 1)})

    return candidates.groupBy("query").applyInPandas(pick, "query long, id long, place long")


def isotonic(points: DataFrame) -> DataFrame:
    """``x, fitted``: the pool-adjacent-violators fit of ``points(x, y)``.

    Rows are summed by x first; what is pooled in one task is a row for each
    distinct score, so round the scores if they are many.
    """
    by_x = points.groupBy("x").agg(F.sum("y").alias("total"), F.count("*").alias("n")).withColumn("g", F.lit(0))

    def pool(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("x")
        blocks: list[list[float]] = []  # total, n, rows
        for total, n in zip(rows["total"], rows["n"], strict=True):
            blocks.append([float(total), float(n), 1])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                total_, n_, k_ = blocks.pop()
                blocks[-1][0] += total_
                blocks[-1][1] += n_
                blocks[-1][2] += k_
        return pd.DataFrame({"x": rows["x"].to_numpy(float), "fitted": np.repeat([b[0] / b[1] for b in blocks], [int(b[2]) for b in blocks])})

    return by_x.groupBy("g").applyInPandas(pool, "x double, fitted double")
