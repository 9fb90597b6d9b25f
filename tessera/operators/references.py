"""References from records to other records that may arrive later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The record of each key that is greatest by ``order``."""
    rest = [c for c in records.columns if c != key]
    best = records.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(key, "_best.*")


def resolve(refs: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """``refs`` with ``target`` and ``state``: resolved, or unresolved without a target; none is dropped."""
    found = refs.join(targets.select(key, "target"), key, "left")
    return found.withColumn("state", F.when(F.col("target").isNull(), "unresolved").otherwise("resolved"))


def heal(resolved: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """A later run: what was unresolved is joined again and is then ``healed`` where its target has come."""
    again = resolve(resolved.where("state = 'unresolved'").drop("target", "state"), targets, key)
    return resolved.where("state <> 'unresolved'").unionByName(again.withColumn("state", F.when(F.col("state") == "resolved", "healed").otherwise("unresolved")).select(*resolved.columns))
