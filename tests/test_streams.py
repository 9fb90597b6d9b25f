"""Debounce with a greatest delay and the hand-off, over several batches with restarts between them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import streams as S

ZERO = dt.datetime(2024, 1, 1)


def bursts(arrivals, late=S.LATE):
    end = max((at for _, at in arrivals), default=0) - late
    out = []
    for cluster in {c for c, _ in arrivals}:
        times, group = sorted(at for c, at in arrivals if c == cluster), []
        due = lambda g: min(g[-1] + S.GAP, g[0] + S.MOST_DELAY)
        for at in [*times, None]:
            if group and (at is None or at >= due(group)):
                if due(group) < end:
                    out.append((cluster, group[0], group[-1], len(group), "overdue" if group[0] + S.MOST_DELAY < group[-1] + S.GAP else "quiet"))
                group = []
            if at is not None:
                group.append(at)
    return sorted(out, key=str)


def told(df):
    base = int(ZERO.replace(tzinfo=dt.UTC).timestamp())
    return sorted(((r["cluster"], r["first_us"] // 1_000_000 - base, r["last_us"] // 1_000_000 - base, r["n"], r["reason"]) for r in df.collect()), key=str)


def files(spark, folder, batches):
    """One file a batch, in order of time of change."""
    for rows in batches:
        spark.createDataFrame(rows, "cluster long, at timestamp").coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, place):
    stream = spark.readStream.schema("cluster long, at timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    S.debounced_at_most(stream).writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(S.FLUSHES).parquet(f"{place}/rows")


@pytest.mark.parametrize("seed", [1, 2])
def test_debounce_over_batches_and_restarts(spark, tmp_path, seed):
    rng = random.Random(seed)
    arrivals, clock = [], 0
    for _ in range(400):
        clock += rng.choice([0, 20, 60, 179, 180, 181, 400])
        arrivals.append((rng.choice([1, 1, 1, 2, None]), clock))
    late = sorted(arrivals, key=lambda a: a[1] + rng.randint(0, S.LATE - 1))
    rows = [(c, ZERO + dt.timedelta(seconds=at)) for c, at in late]
    folder, place = str(tmp_path / "in"), str(tmp_path / "out")
    files(spark, folder, [rows[:130], [*rows[130:250], (1, None)]])
    run(spark, folder, place)
    files(spark, folder, [rows[250:]])
    assert told(run(spark, folder, place)) == bursts(arrivals)


def test_a_cluster_that_is_never_quiet_is_told(spark, tmp_path):
    arrivals = [(5, at) for at in range(0, 6000, 100)]
    folder = str(tmp_path / "in")
    files(spark, folder, [[(c, ZERO + dt.timedelta(seconds=at)) for c, at in arrivals]])
    got = told(run(spark, folder, str(tmp_path / "out")))
    assert got == bursts(arrivals) and [g[1] for g in got] == [0, 1800] and {g[4] for g in got} == {"overdue"}


class Refused(Exception):
    pass


def test_hand_off_lands_once_and_offers_again(spark, tmp_path):
    folder, place = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id long, body string, extra int"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    offers = []

    def queue(accepts):
        def take(rows):
            offers.append(sorted(r["body"] or "-" for r in rows.collect()))
            return rows.where(F.coalesce("body", F.lit("-")).isin(*accepts))

        return take

    def go(take):
        S.hand_off(spark.readStream.schema(schema).parquet(folder), ["body"], take, place)
        return sorted((r["body"] or "-", r["status"]) for r in S.handed_rows(spark, place).collect())

    put([(1, "a", 1), (2, "a", 2), (3, "b", 3), (4, None, 4), (5, None, 5)])
    assert go(queue(["a"])) == [("-", "pending"), ("a", "queued"), ("b", "pending")]
    assert offers == [["-", "a", "b"]]

    def fails(rows):
        rows.count()
        raise Refused

    put([(6, "b", 6), (7, "c", 7)])
    with pytest.raises(Exception, match="Refused"):
        go(fails)
    assert go(queue(["b"])) == [("-", "pending"), ("a", "queued"), ("b", "queued"), ("c", "pending")]
    assert offers[1:] == [["-", "b", "c"]]
    put([(8, "a", 8)])
    assert go(queue(["-", "c"])) == [("-", "queued"), ("a", "queued"), ("b", "queued"), ("c", "queued")]
    assert offers[2:] == [["-", "c"]]
    assert sum(len(o) for o in offers) == 3 + 3 + 2
