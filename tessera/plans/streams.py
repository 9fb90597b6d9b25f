"""The streaming operators over ``events``, each against the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.streaming import streams as S

_LAST = "(SELECT max(ts) AS now FROM events)"


@query("st03_dedup_stream", "SELECT DISTINCT user_id, props FROM events")
def dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.events_stream(spark, f"{sf_dir}/events.parquet")
    return S.drain(S.first_seen(events, ["user_id", "props"], "60 days")).select("user_id", "props")


@query("st06_day_rollup_stream", f"SELECT user_id, day, count(*) AS n, max(value) AS worst FROM (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, value FROM events), {_LAST} GROUP BY user_id, day HAVING day + INTERVAL 1 DAY <= date_trunc('millisecond', max(now)) - INTERVAL 1 HOUR")
def day_rollup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day is still open when the stream has read all."""
    return S.drain(S.day_rollup(S.events_stream(spark, f"{sf_dir}/events.parquet")))


@query(
    "st07_sliding_stream",
    f"""WITH w AS (SELECT event_type, unnest(range(time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 50 MINUTE, time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 1 MINUTE, INTERVAL 10 MINUTE)) AS start FROM events)
        SELECT event_type, start, count(*) AS n FROM w, {_LAST} GROUP BY 1, 2 HAVING start + INTERVAL 60 MINUTE <= date_trunc('millisecond', max(now)) - INTERVAL 1 HOUR""",
)
def sliding_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drain(S.sliding_counts(S.events_stream(spark, f"{sf_dir}/events.parquet")))


@query(
    "st04_debounce_stream",
    f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 180 SECOND THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM g)
        SELECT user_id, min(ts) AS start, count(*) AS n FROM s, {_LAST} GROUP BY user_id, burst HAVING max(ts) + INTERVAL 180 SECOND <= date_trunc('millisecond', max(now)) - INTERVAL 10 MINUTE""",
)
def debounce_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drain(S.debounced(S.events_stream(spark, f"{sf_dir}/events.parquet")))


@query(
    "st09_state_change_stream",
    """WITH o AS (SELECT user_id, event_type, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS to_value, lag(CAST(json_extract_string(props, '$.k') AS BIGINT)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS from_value FROM events)
       SELECT user_id, event_type, event_id, from_value, to_value FROM o WHERE from_value IS DISTINCT FROM to_value""",
)
def state_change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drain(S.state_changes(S.events_stream(spark, f"{sf_dir}/events.parquet")))


@query("st05_growth_gate_stream", "SELECT user_id AS cluster, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS size FROM events GROUP BY 1 HAVING max(CAST(json_extract_string(props, '$.k') AS BIGINT)) >= 3")
def growth_gate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one batch of the table passes every cluster once, at its greatest size; tests go through several batches."""
    sizes = S.events_stream(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("cluster"), F.get_json_object("props", "$.k").cast("long").alias("size"))
    return S.drain(S.growth_gate(sizes))


#: Fixed expressions of both engines: microseconds since 1970 twenty times as dense, and the cluster an event belongs to.
_AT = "epoch_us(ts) // 20"


@query(
    "st04_debounce_at_most",
    f"""WITH RECURSIVE a AS (SELECT user_id % 8 AS cluster, {_AT} AS us, count(*) AS n FROM events GROUP BY 1, 2),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY cluster ORDER BY us) AS run FROM (SELECT *, CASE WHEN us < lag(us) OVER (PARTITION BY cluster ORDER BY us) + {S.GAP} * 1000000 THEN 0 ELSE 1 END AS fresh FROM a)),
        o AS (SELECT cluster, run, us, n, row_number() OVER (PARTITION BY cluster, run ORDER BY us) AS k FROM g),
        r AS (SELECT cluster, run, us, n, k, us AS first FROM o WHERE k = 1 UNION ALL SELECT o.cluster, o.run, o.us, o.n, o.k, CASE WHEN o.us >= r.first + {S.MOST_DELAY} * 1000000 THEN o.us ELSE r.first END FROM r JOIN o ON o.cluster = r.cluster AND o.run = r.run AND o.k = r.k + 1),
        b AS (SELECT cluster, first AS first_us, max(us) AS last_us, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY cluster, run, first)
        SELECT *, CASE WHEN first_us + {S.MOST_DELAY} * 1000000 < last_us + {S.GAP} * 1000000 THEN 'overdue' ELSE 'quiet' END AS reason FROM b
        WHERE least(first_us + {S.MOST_DELAY} * 1000000, last_us + {S.GAP} * 1000000) < (SELECT max({_AT}) // 1000 * 1000 FROM events) - {S.LATE} * 1000000""",
)
def debounce_at_most_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of a cluster that are told when it is quiet, or overdue."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) div 20")
    events = S.events_stream(spark, f"{sf_dir}/events.parquet").select((F.col("user_id") % 8).alias("cluster"), F.timestamp_micros(us).alias("at"))
    return S.drain(S.debounced_at_most(events))


@query("st03_hand_off", "SELECT user_id, props, CASE WHEN user_id % 10 = 0 THEN 'pending' ELSE 'queued' END AS status FROM (SELECT DISTINCT user_id, props FROM events)")
def hand_off_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents landed once; the queue takes none of every tenth user's."""
    place = S.fresh_place(spark)
    S.hand_off(S.events_stream(spark, f"{sf_dir}/events.parquet").select("user_id", "props"), ["user_id", "props"], lambda rows: rows.where("user_id % 10 <> 0"), place)
    return S.handed_rows(spark, place)
