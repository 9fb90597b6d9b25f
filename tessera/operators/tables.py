"""Changes of tables, as the next state of a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import saved


def latest_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in ``order`` (end it with an id, for a total order)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def new_rows_by_hash(batch: DataFrame, existing: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``batch`` whose keys ``existing`` lacks, one of each key."""
    return latest_per_key(batch.join(existing, keys, "left_anti"), keys, [order])


def insert_missing(active: DataFrame, coming: DataFrame, keys: list[str]) -> DataFrame:
    """``active`` and the rows of ``coming`` with a key it lacks, one of each key; nothing is overwritten."""
    return active.unionByName(coming.join(active, keys, "left_anti").dropDuplicates(keys))


def close_and_replace(current: DataFrame, new: DataFrame, keys: list[str], moment: Column) -> DataFrame:
    """Slowly changing rows: open rows that ``new`` replaces end at ``moment``, where the new ones start."""
    flagged = current.join(new.select(*keys).distinct().withColumn("_new", F.lit(True)), keys, "left")
    closed = flagged.withColumn("valid_to", F.when(F.col("_new") & F.col("valid_to").isNull(), moment).otherwise(F.col("valid_to"))).drop("_new")
    return closed.unionByName(new.withColumns({"valid_from": moment, "valid_to": F.lit(None).cast("timestamp_ntz")}))


def orphans(rows: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose parent is gone."""
    return rows.join(parents, keys, "left_anti")


def global_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``name``, the row number in ``order``, without one task that holds all rows.

    Rows are dealt by ranges and numbered in their range; a range starts after
    the rows of those before it, which takes one count for each range.
    """
    at, place = "_range", "_place"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Kept once, as sampled range bounds may differ in another run.
    ranged = saved(ranged.select("*", F.spark_partition_id().alias(at), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(place)))
    counts = {r[at]: r["count"] for r in ranged.groupBy(at).count().collect()}
    starts, total = [], 0
    for k in sorted(counts):
        starts.append((k, total))
        total += counts[k]
    before = df.sparkSession.createDataFrame(starts, f"{at} int, _before long")
    return ranged.join(F.broadcast(before), at).select(*df.columns, (F.col("_before") + F.col(place) + 1).alias(name))
