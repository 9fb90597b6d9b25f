"""Structured Streaming forms of the incremental operators.

``drain`` runs a stream over what is there now (``availableNow``) into Parquet
under the shared checkpoint folder and gives the result as a DataFrame; a
service starts the same DataFrames with its own trigger, sink and folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.graph import scratch_folder


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """The files at ``path`` (a folder or one file) as a stream; watermarks need ``ts`` with a time zone, the session's."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def fresh_place(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or scratch_folder(spark)
    return f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame) -> DataFrame:
    spark, place = stream.sparkSession, fresh_place(stream.sparkSession)
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def first_seen(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """One row of each key; a key is remembered as long as events may be ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def day_rollup(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events of each user and day, once the day is over and late ones are in."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.count("*").alias("n"), F.max("value").alias("worst")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "worst")


def sliding_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Trailing 60 minutes every 10 minutes, by kind of event."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "60 minutes", "10 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def debounced(events: DataFrame, gap: str = "180 seconds", late: str = "10 minutes") -> DataFrame:
    """Bursts of one user: events closer than ``gap`` belong together."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


GAP, MOST_DELAY, LATE = 180, 1800, 600
FLUSHES = "cluster long, first_us long, last_us long, n long, reason string"


def debounced_at_most(arrivals: DataFrame, gap: int = GAP, most: int = MOST_DELAY, late: int = LATE) -> DataFrame:
    """``arrivals(cluster, at)`` as bursts ``cluster, first_us, last_us, n, reason``.

    A burst is told ``gap`` seconds after its last arrival (``quiet``) or
    ``most`` seconds after its first (``overdue``), whichever comes first; what
    arrives then or later starts the next one.  Arrivals may be ``late``
    seconds out of order: they wait until the watermark has passed them, so the
    order of files and the cut of batches change nothing.  The state of a
    cluster has its open burst and the arrivals of the last ``late`` seconds
    and of one trigger, equal times counted: a long history is read in triggers
    of few files.  Null times are dropped, a null cluster is one cluster.
    """
    second = 1_000_000

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n, at, count = state.get if state.exists else (None, None, 0, [], [])
        waiting = dict(zip(at, count, strict=True))
        for r in rows:
            for t, c in r["us"].value_counts().items():
                waiting[int(t)] = waiting.get(int(t), 0) + int(c)
        now_ms = max(state.getCurrentWatermarkMs(), 0)
        now, out = now_ms * 1000, []

        def due() -> int:
            return min(last + gap * second, first + most * second)

        def told() -> tuple:
            return (key[0], first, last, n, "overdue" if first + most * second < last + gap * second else "quiet")

        for t in sorted(t for t in waiting if t < now):
            if n and t >= due():
                out.append(told())
                n = 0
            first, last, n = (t if not n else first), t, n + waiting.pop(t)
        if n and due() < now:
            out.append(told())
            first, last, n = None, None, 0
        if n or waiting:
            at = sorted(waiting)
            state.update((first, last, n, at, [waiting[t] for t in at]))
            state.setTimeoutTimestamp(max((due() if n else at[0]) // 1000, now_ms + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["cluster", "first_us", "last_us", "n", "reason"]).astype({"cluster": "Int64"})

    timed = arrivals.where("at IS NOT NULL").select(F.col("cluster").cast("long").alias("cluster"), "at").withWatermark("at", f"{late} seconds").select("cluster", "at", F.unix_micros("at").alias("us"))
    return timed.groupBy("cluster").applyInPandasWithState(step, FLUSHES, "first long, last long, n long, at array<long>, count array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def hand_off(stream: DataFrame, keys: list[str], take: Callable[[DataFrame], DataFrame], place: str) -> None:
    """Land new rows once and hand them to ``take``, which returns the ``_hash`` of what it took; the rest is offered again with the next batch.

    ``place`` has, by batch, ``landed`` (all rows, one of each content of
    ``keys``), ``handed`` and ``pending`` (hashes).  A batch that is run again
    after a crash overwrites its own parts and reads those of earlier batches
    only, so rows are landed once; a crash between ``take`` and the end of its
    batch offers that batch's rows again, with the same hashes.  If ``take``
    raises, the stream stops and a restart goes on with the same batch.
    A null in a key is a value.  Runs over what is there now.
    """
    spark = stream.sparkSession
    whole = f"_batch long, {stream.schema.toDDL()}, _hash string"

    def earlier(part: str, schema: str, batch: int) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{place}/{part}").where(F.col("_batch") < batch)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def write(rows: DataFrame, part: str, batch: int) -> DataFrame:
        to = str(PurePosixPath(part) / f"_batch={batch}")
        rows.write.mode("overwrite").parquet(f"{place}/{to}")
        return spark.read.schema(rows.schema).parquet(f"{place}/{to}")

    def one(rows: DataFrame, batch: int) -> None:
        content = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
        fresh = rows.withColumn("_hash", content).dropDuplicates(["_hash"]).join(earlier("landed", whole, batch).select("_hash"), "_hash", "left_anti").select(*rows.columns, "_hash")
        landed = write(fresh, "landed", batch)
        before = earlier("pending", "_batch long, _hash string", batch)
        last = before.agg(F.max("_batch")).collect()[0][0]
        left_over = before.where(F.col("_batch") == last).select("_hash")
        again = earlier("landed", whole, batch).join(left_over, "_hash", "left_semi").select(*landed.columns)
        offered = landed.unionByName(again)
        handed = write(take(offered).select("_hash").distinct(), "handed", batch)
        write(offered.select("_hash").join(handed, "_hash", "left_anti"), "pending", batch)

    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()


def handed_rows(spark: SparkSession, place: str) -> DataFrame:
    """All landed rows with ``status``: ``queued`` or ``pending``."""
    landed, handed = (spark.read.parquet(f"{place}/{part}").drop("_batch") for part in ("landed", "handed"))
    return landed.join(handed.select("_hash", F.lit("queued").alias("_s")).distinct(), "_hash", "left").withColumn("status", F.coalesce("_s", F.lit("pending"))).drop("_s", "_hash")


CHANGES = "user_id long, event_type string, event_id long, from_value long, to_value long"


def state_changes(events: DataFrame) -> DataFrame:
    """(from, to) whenever the value ``k`` of a user's kind of event changes; the last value is the state."""

    def diff(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        # Most groups are small, so frames are built once and nothing is sorted or cast by pandas.
        ts, ids, null, value = (np.concatenate(x) for x in zip(*((r["ts"].to_numpy(), r["event_id"].to_numpy(), r["k"].isna().to_numpy(), r["k"].to_numpy()) for r in rows), strict=True))
        order = np.lexsort((ids, ts))
        ids, null, value = ids[order], null[order], np.where(null, 0, value)[order].astype("int64")
        was_null, was = np.append(last is None, null[:-1]), np.append(last or 0, value[:-1])
        new = (null != was_null) | (value != was)
        state.update((None if null[-1] else int(value[-1]),))
        same = lambda x, kind: np.full(new.sum(), x, kind)
        yield pd.DataFrame({"user_id": same(key[0], "int64"), "event_type": same(key[1], object), "event_id": ids[new], "from_value": pd.arrays.IntegerArray(was[new], was_null[new]), "to_value": pd.arrays.IntegerArray(value[new], null[new])}, copy=False)

    keyed = events.select("user_id", "event_type", "event_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return keyed.groupBy("user_id", "event_type").applyInPandasWithState(diff, CHANGES, "last long", "append", GroupStateTimeout.NoTimeout)


def growth_gate(sizes: DataFrame, least: int = 3, factor: float = 1.5) -> DataFrame:
    """``sizes(cluster, size)``: a cluster passes at ``least`` members and again whenever it grew by half."""

    def gate(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent = state.get[0] if state.exists else 0
        size = max(int(r["size"].max()) for r in rows)
        passed = size >= least and size >= factor * sent
        state.update((size if passed else sent,))
        yield pd.DataFrame({"cluster": [key[0]] * passed, "size": [size] * passed})

    return sizes.groupBy("cluster").applyInPandasWithState(gate, "cluster long, size long", "sent long", "append", GroupStateTimeout.NoTimeout)
