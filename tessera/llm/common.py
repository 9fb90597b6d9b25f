"""What the operators share: table loading, checkpoints, held-out rows, bounded samples."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or the checkpoint folder that was set.

    Where neither is set and Spark runs on one machine, as in tests, a
    temporary folder is set; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that its lineage is cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a partition, at least, and partitions that are no reason to count rows.
HELD_ROWS, FEW_PARTITIONS = 2000, 32


def held(df: DataFrame) -> DataFrame:
    """``saved`` for rows of some hundred bytes: partitions of a few rows are read together.

    A shuffle keeps some files for each partition that it reads, which is most
    of the disk when a loop passes small tables over many partitions.  Large
    tables keep all of theirs.
    """
    out = saved(df)
    parts = out.rdd.getNumPartitions()
    if parts <= FEW_PARTITIONS:
        return out
    fewer = max(1, out.count() // HELD_ROWS)
    return out.coalesce(fewer) if fewer < parts else out


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def add_fields(df: DataFrame, value: Column, names: tuple[str, ...]) -> DataFrame:
    """``df`` with fields ``names`` of the struct ``value`` as columns; they replace columns of the same name."""
    held = fresh_name(df, "_value")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.withColumn(held, value).select(*kept, *(F.col(held)[n].alias(n) for n in names))


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0.  A null id counts as an empty text, whose remainder is 0."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(5)) == 0


def bounded_sample(df: DataFrame, label: str, key: str, bound: int, total: int | None = None) -> tuple[DataFrame, dict]:
    """About ``bound`` rows of each label at most, ``total`` of all, chosen by a hash of ``key``, and the count of each label.

    ``df`` is the labelled rows.  A label with fewer rows than ``bound`` keeps
    all.  The same rows give the same sample, however they are partitioned.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().orderBy(label).collect()}
    if total and counts:
        bound = min(bound, max(1, total // len(counts)))
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, bound / n))).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.where(place < share), counts


def one_text_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen`` (few rows, by ``doc_id``) with the ``text`` of their documents.

    Of documents that repeat an id, the one whose text has the least hash
    stands for it, so there are no more rows than ``chosen`` has.  Only texts
    of repeated ids are shuffled.
    """
    others = [c for c in chosen.columns if c != "doc_id"]
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    repeated = saved(docs.select("doc_id").join(F.broadcast(chosen.select("doc_id")), "doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not repeated.limit(1).count():
        return found.select("doc_id", *others, "text")
    few = F.broadcast(repeated)  # no more than chosen has
    first = found.join(few, "doc_id", "left_semi").groupBy("doc_id", *others).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return found.join(few, "doc_id", "left_anti").select("doc_id", *others, "text").unionByName(first)
