"""The training-data pipeline: stages over ``documents``, each written as Parquet before the next one reads it.

1. toxicity: documents scored 0.5 or more go.
2. near duplicates: one document, that with the least id, stays of each group
   of documents that the n-gram Jaccard join links.
3. decontamination: documents into which a benchmark item leaked go.
4. secrets: every secret is replaced by a mask; all documents stay.
5. mixing: what the mix takes of each source, with the number of copies.

Stages 1 to 4 return the columns of ``documents``; stage 5 returns a row for
each document that the mix takes.  A null id is kept by every stage: nothing
links it.  Repeated rows are copies of each other, of which one stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh_name, load, shared_folder
from tessera.llm.decontaminate import find_leaks
from tessera.llm.jaccard import near_duplicate_representatives
from tessera.llm.mixing import mix_sources
from tessera.llm.secret_scan import redact_secrets
from tessera.llm.toxicity import fit_toxicity, score_toxicity

TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = score_toxicity(docs, fit_toxicity(docs, load(spark, sf_dir, "labels")))
    return scored.where(F.col("toxicity") < TOXIC_FROM).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicate_representatives(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = fresh_name(docs, "_leaks")
    return find_leaks(docs, load(spark, sf_dir, "benchmark"), leaks).where(F.size(leaks) == 0).drop(leaks)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = redact_secrets(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in docs.columns else masked


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs).where(F.col("taken") > 0).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaked),
    ("secrets", mask_secrets),
    ("mixing", mix),
]

#: SQL can't express the fitted toxicity model, nor the random rounding of the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is kept in the shared checkpoint folder of the session."""
    docs, place = load(spark, sf_dir, "documents"), f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        at = f"{place}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
