"""Aggregations over events (operational log), orders/lineitem (cases and items) and labels (outcomes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.stats import safe_ratio, trust_level, wilson_lower
from tessera.operators.followers import followers
from tessera.plans.registry import load, query


def _k(column: str = "props") -> F.Column:
    return F.get_json_object(column, "$.k").cast("long")


@query("a01_count_by_key", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def count_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("a02_distinct_degree", "SELECT l_partkey AS node, count(DISTINCT l_orderkey) AS degree FROM lineitem GROUP BY l_partkey")
def distinct_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.countDistinct("l_orderkey").alias("degree"))


@query(
    "a03_distinct_endpoints",
    """SELECT kind, count(DISTINCT id) AS n FROM (
         SELECT 'part' AS kind, l_partkey AS id FROM lineitem UNION ALL SELECT 'supplier', l_suppkey FROM lineitem) GROUP BY kind""",
)
def distinct_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    ends = lines.select(F.lit("part").alias("kind"), F.col("l_partkey").alias("id")).unionByName(lines.select(F.lit("supplier").alias("kind"), F.col("l_suppkey").alias("id")))
    return ends.groupBy("kind").agg(F.countDistinct("id").alias("n"))


@query(
    "a04_filtered_counts",
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 100) AS large,
              count(value) AS with_value, max(ts) AS last_seen FROM events GROUP BY user_id""",
)
def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 100).alias("large"), F.count("value").alias("with_value"), F.max("ts").alias("last_seen"))


@query("a05_having", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 5")
def having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("n")).where("n >= 5")


@query(
    "a06_dashboard",
    """SELECT (SELECT count(*) FROM events WHERE event_type = 'error') AS errors,
              (SELECT count(*) FROM events, (SELECT max(ts) AS now FROM events) WHERE ts > now - INTERVAL 10 MINUTE) AS last_10m,
              (SELECT count(*) FROM events WHERE value IS NULL) AS without_value,
              (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders,
              (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS closed_orders,
              (SELECT count(*) FROM documents) AS documents""",
)
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, orders = load(spark, sf_dir, "events"), load(spark, sf_dir, "orders")
    now = events.agg(F.max("ts").alias("now"))
    recent = events.join(F.broadcast(now)).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("ts") > F.col("now") - F.expr("INTERVAL 10 MINUTE")).alias("last_10m"), F.count_if(F.col("value").isNull()).alias("without_value"))
    by_state = orders.agg(F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("closed_orders"))
    docs = load(spark, sf_dir, "documents").agg(F.count("*").alias("documents"))
    return recent.join(by_state).join(docs)  # one row each


@query(
    "a07_percentiles",
    """SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS max_k
       FROM events, (SELECT max(ts) AS now FROM events) WHERE ts > now - INTERVAL 7 DAY""",
)
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    recent = events.join(F.broadcast(events.agg(F.max("ts").alias("now")))).where(F.col("ts") > F.col("now") - F.expr("INTERVAL 7 DAY"))
    return recent.agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.max(_k()).alias("max_k"))


@query(
    "a08_median_by_json_key",
    """SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, round(quantile_cont(value, 0.5), 6) AS p50, count(*) AS calls
       FROM events GROUP BY 1""",
)
def median_by_json_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy(_k().alias("k")).agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.count("*").alias("calls"))


#: Price of 1,000 tokens by kind of event, for the spend reports.
PRICES = {"view": 0.15, "click": 0.6, "signup": 2.5, "purchase": 10.0}
_PRICE_ROWS = ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in PRICES.items())


@query(
    "a09_spend_by_model",
    f"""SELECT e.event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS tokens,
               round(sum(CAST(json_extract_string(props, '$.k') AS BIGINT) * coalesce(p.price, 0.0) / 1000), 6) AS cost
        FROM events e LEFT JOIN (VALUES {_PRICE_ROWS}) p(event_type, price) USING (event_type) GROUP BY e.event_type""",
)
def spend_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend without a cached-token discount; an unknown model costs nothing."""
    prices = spark.createDataFrame(list(PRICES.items()), "event_type string, price double")
    priced = load(spark, sf_dir, "events").join(F.broadcast(prices), "event_type", "left")
    return priced.groupBy("event_type").agg(F.sum(_k()).alias("tokens"), F.round(F.sum(_k() * F.coalesce("price", F.lit(0.0)) / 1000), 6).alias("cost"))


@query(
    "a10_llm_usage",
    f"""WITH u AS (SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, least(CAST(json_extract_string(props, '$.k') AS BIGINT), CAST(floor(value) AS BIGINT)) AS cached, coalesce(p.price, 0.0) AS price
             FROM events LEFT JOIN (VALUES {_PRICE_ROWS}) p(event_type, price) USING (event_type))
        SELECT event_type, user_id % 10 AS task, count(*) AS calls, sum(k) AS tokens, sum(cached) AS cached_tokens,
               round(sum(cached) / sum(k), 6) AS cache_hit_rate, round(sum(round(((k - cached) * price + cached * price * 0.5) / 1000, 6)), 4) AS cost
        FROM u GROUP BY 1, 2 HAVING sum(k) > 0 ORDER BY tokens DESC, event_type, task LIMIT 20""",
)
def llm_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 20 of (model, task) by tokens; cached tokens cost half, each call is rounded to 6 places."""
    prices = spark.createDataFrame(list(PRICES.items()), "event_type string, price double")
    used = load(spark, sf_dir, "events").join(F.broadcast(prices), "event_type", "left").select("event_type", (F.col("user_id") % 10).alias("task"), _k().alias("k"), F.least(_k(), F.floor("value")).alias("cached"), F.coalesce("price", F.lit(0.0)).alias("price"))
    cost = F.round(((F.col("k") - F.col("cached")) * F.col("price") + F.col("cached") * F.col("price") * 0.5) / 1000, 6)
    out = used.groupBy("event_type", "task").agg(F.count("*").alias("calls"), F.sum("k").alias("tokens"), F.sum("cached").alias("cached_tokens"), F.round(F.sum("cached") / F.sum("k"), 6).alias("cache_hit_rate"), F.round(F.sum(cost), 4).alias("cost"))
    return out.where("tokens > 0").orderBy(F.desc("tokens"), "event_type", "task").limit(20)


@query(
    "a11_current_day_usage",
    "SELECT user_id, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS tokens, round(sum(value), 4) AS cost FROM events, (SELECT max(ts) AS now FROM events) WHERE ts >= date_trunc('day', now) GROUP BY user_id",
)
def current_day_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    now = F.broadcast(events.agg(F.max("ts").alias("now")))
    return events.join(now).where(F.col("ts") >= F.date_trunc("day", "now")).groupBy("user_id").agg(F.sum(_k()).alias("tokens"), F.round(F.sum("value"), 4).alias("cost"))


@query(
    "a12_outcome_histogram",
    "SELECT o_orderpriority AS kind, o_orderstatus AS outcome, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS total FROM orders GROUP BY 1, 2",
)
def outcome_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("outcome")).agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy("kind")))


@query(
    "a13_pattern_failure_rate",
    """WITH done AS (SELECT o_orderpriority AS kind, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) >= 5),
            every AS (SELECT o_orderpriority AS kind, count(*) AS total FROM orders GROUP BY 1)
       SELECT kind, n, total, round(1 - n / total, 6) AS failure_rate FROM done JOIN every USING (kind)""",
)
def pattern_failure_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numerator counts finished rows only, the denominator all."""
    orders = load(spark, sf_dir, "orders")
    both = orders.groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"), F.count("*").alias("total"))
    return both.where("n >= 5").withColumn("failure_rate", F.round(1 - F.col("n") / F.col("total"), 6))


_CONF = "least(value / 100, 1.0)"


@query(
    "a14_calibration_buckets",
    f"SELECT floor({_CONF} * 10) / 10 AS bucket, count(*) AS n, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM events GROUP BY 1",
)
def calibration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven buckets: confidence 1.0 is one of its own."""
    conf = F.least(F.col("value") / 100, F.lit(1.0))
    return load(spark, sf_dir, "events").groupBy((F.floor(conf * 10) / 10).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("event_type") == "purchase").cast("double")), 6).alias("rate"))


@query("a15_brier_score", f"SELECT event_type, round(avg(power({_CONF} - CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END, 2)), 6) AS brier FROM events GROUP BY event_type")
def brier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = F.least(F.col("value") / 100, F.lit(1.0))
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg(F.pow(conf - (F.col("user_id") % 2 == 0).cast("int"), 2)), 6).alias("brier"))


@query(
    "a16_expected_calibration_error",
    f"""WITH b AS (SELECT event_type, least(9, CAST(floor({_CONF} * 10) AS INT)) AS bin, {_CONF} AS p, CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS y FROM events),
             g AS (SELECT event_type, bin, count(*) AS n, abs(avg(y) - avg(p)) AS gap FROM b GROUP BY 1, 2)
        SELECT event_type, round(sum(n * gap) / sum(n), 6) AS ece FROM g GROUP BY event_type""",
)
def expected_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten bins; p = 1.0 is in the last."""
    p = F.least(F.col("value") / 100, F.lit(1.0))
    bins = load(spark, sf_dir, "events").select("event_type", F.least(F.lit(9), F.floor(p * 10).cast("int")).alias("bin"), p.alias("p"), (F.col("user_id") % 2 == 0).cast("double").alias("y"))
    gaps = bins.groupBy("event_type", "bin").agg(F.count("*").alias("n"), F.abs(F.avg("y") - F.avg("p")).alias("gap"))
    return gaps.groupBy("event_type").agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"))


@query(
    "a17_retrieval_metrics",
    """WITH r AS (SELECT l_orderkey AS qid, l_partkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rk FROM lineitem),
            w AS (SELECT l_orderkey AS qid, min(l_partkey) AS want FROM lineitem GROUP BY 1),
            p AS (SELECT w.qid, min(r.rk) AS pos FROM w JOIN r ON r.qid = w.qid AND r.key = w.want GROUP BY w.qid)
       SELECT o_orderpriority AS label, count(*) AS n, round(avg(CASE WHEN pos = 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN pos <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall3,
              round(avg(CASE WHEN pos <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall10, round(avg(1.0 / pos), 6) AS mrr
       FROM p JOIN orders ON o_orderkey = qid GROUP BY 1""",
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-1, recall and mean reciprocal rank of a wanted key in each query's ranking, by label."""
    lines = load(spark, sf_dir, "lineitem")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey"))
    ranked = lines.select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("key"), rank.alias("rk"), F.min("l_partkey").over(Window.partitionBy("l_orderkey")).alias("want"))
    places = ranked.where("key = want").groupBy("qid").agg(F.min("rk").alias("pos"))
    hit = lambda k: F.round(F.avg((F.col("pos") <= k).cast("double")), 6)
    return places.join(load(spark, sf_dir, "orders"), F.col("qid") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"), hit(1).alias("top1"), hit(3).alias("recall3"), hit(10).alias("recall10"), F.round(F.avg(1.0 / F.col("pos")), 6).alias("mrr"))


_EFFICACY = """SELECT user_id AS pattern_id, count(*) FILTER (WHERE event_type = 'purchase') AS successes, count(*) FILTER (WHERE event_type = 'error') AS failures,
              count(*) FILTER (WHERE event_type = 'view') AS unknown, count(*) AS observed, max(ts) AS last_observed,
              CASE WHEN count(*) FILTER (WHERE event_type IN ('purchase', 'error')) > 0 THEN round(count(*) FILTER (WHERE event_type = 'purchase') / count(*) FILTER (WHERE event_type IN ('purchase', 'error')), 6) END AS success_rate
       FROM events GROUP BY user_id"""


def efficacy(events: DataFrame) -> DataFrame:
    """Outcome counts of each pattern and its success rate, null without a decided outcome."""
    wins, losses = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "error")
    return events.groupBy(F.col("user_id").alias("pattern_id")).agg(wins.alias("successes"), losses.alias("failures"), F.count_if(F.col("event_type") == "view").alias("unknown"), F.count("*").alias("observed"), F.max("ts").alias("last_observed"), F.round(safe_ratio(wins, wins + losses), 6).alias("success_rate"))


@query("a18_pattern_efficacy", _EFFICACY)
def pattern_efficacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return efficacy(load(spark, sf_dir, "events"))


@query(
    "a19_confidence_census",
    f"""SELECT CASE WHEN success_rate IS NULL THEN 'unproven' WHEN successes + failures >= 30 THEN 'measured' WHEN successes + failures >= 10 THEN 'indicative' ELSE 'sparse' END AS class, count(*) AS patterns
        FROM ({_EFFICACY}) GROUP BY 1""",
)
def confidence_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = F.col("successes") + F.col("failures")
    kind = F.when(F.col("success_rate").isNull(), "unproven").when(decided >= 30, "measured").when(decided >= 10, "indicative").otherwise("sparse")
    return efficacy(load(spark, sf_dir, "events")).groupBy(kind.alias("class")).agg(F.count("*").alias("patterns"))


@query(
    "a20_cohort_attributes",
    """WITH c AS (SELECT l_orderkey AS cohort, p_brand, p_type, CAST(p_size % 3 AS VARCHAR) AS p_size FROM lineitem JOIN part ON p_partkey = l_partkey),
            u AS (SELECT cohort, 'brand' AS dim, p_brand AS val FROM c UNION ALL SELECT cohort, 'type', p_type FROM c UNION ALL SELECT cohort, 'size', p_size FROM c),
            n AS (SELECT cohort, dim, val, count(*) AS n, sum(count(*)) OVER (PARTITION BY cohort, dim) AS total, row_number() OVER (PARTITION BY cohort, dim ORDER BY count(*) DESC, val) AS rk FROM u GROUP BY 1, 2, 3)
       SELECT cohort, dim, val, n, round(n / total, 6) AS coverage FROM n WHERE rk = 1 AND n >= 3 AND n / total >= 0.6""",
)
def cohort_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest value of each attribute of a cohort, where it covers 60 % and three members or more."""
    cohort = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    long = cohort.select(F.col("l_orderkey").alias("cohort"), F.explode(F.map_from_arrays(F.array(F.lit("brand"), F.lit("type"), F.lit("size")), F.array("p_brand", "p_type", (F.col("p_size") % 3).cast("string")))).alias("dim", "val"))
    counts = long.groupBy("cohort", "dim", "val").agg(F.count("*").alias("n"))
    w = Window.partitionBy("cohort", "dim")
    best = counts.withColumn("total", F.sum("n").over(w)).withColumn("rk", F.row_number().over(w.orderBy(F.desc("n"), "val")))
    return best.where("rk = 1 AND n >= 3 AND n / total >= 0.6").select("cohort", "dim", "val", "n", F.round(F.col("n") / F.col("total"), 6).alias("coverage"))


@query(
    "a21_fix_outcomes_by_grain",
    """WITH x AS (SELECT p_brand, p_type, p_name, l_returnflag FROM lineitem JOIN part ON p_partkey = l_partkey),
            g AS (SELECT 'model' AS grain, p_name AS key, l_returnflag FROM x UNION ALL SELECT 'class', p_brand, l_returnflag FROM x UNION ALL SELECT 'family', p_type, l_returnflag FROM x)
       SELECT grain, key, count(*) FILTER (WHERE l_returnflag = 'N') AS successes, count(*) FILTER (WHERE l_returnflag = 'R') AS failures,
              count(*) FILTER (WHERE l_returnflag = 'N') >= 3 AND count(*) FILTER (WHERE l_returnflag = 'R') * 4 <= count(*) FILTER (WHERE l_returnflag = 'N') AS promoted
       FROM g GROUP BY 1, 2""",
)
def fix_outcomes_by_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    grain = lambda name, col: F.struct(F.lit(name).alias("grain"), F.col(col).alias("key"))
    long = joined.select("l_returnflag", F.explode(F.array(grain("model", "p_name"), grain("class", "p_brand"), grain("family", "p_type"))).alias("g")).select("g.grain", "g.key", "l_returnflag")
    wins, losses = F.count_if(F.col("l_returnflag") == "N"), F.count_if(F.col("l_returnflag") == "R")
    return long.groupBy("grain", "key").agg(wins.alias("successes"), losses.alias("failures"), ((wins >= 3) & (losses * 4 <= wins)).alias("promoted"))


@query(
    "a22_fleet_groups",
    """WITH i AS (SELECT DISTINCT s.user_id AS change_id, e.user_id AS incident FROM events s JOIN events e ON s.event_type = 'signup' AND e.event_type = 'error'
                  AND json_extract_string(s.props, '$.k') = json_extract_string(e.props, '$.k') AND e.ts > s.ts AND e.ts <= s.ts + INTERVAL 7 DAY)
       SELECT change_id, count(*) AS incidents, list_slice(list_sort(list(incident)), 1, 200)[1] AS first_incident, sum(incident) AS checksum FROM i GROUP BY 1 HAVING count(*) >= 3""",
)
def fleet_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct incidents on the same item within seven days after a change, and the first of them."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("at")
    events = load(spark, sf_dir, "events").select("user_id", "event_type", micros, _k().alias("k")).where("k IS NOT NULL AND at IS NOT NULL")
    one = lambda kind: events.where(F.col("event_type") == kind).select(F.col("user_id").alias("id"), "k", "at")
    return followers(one("signup"), one("error"), 7 * 86_400_000_000).where("n >= 3").select(F.col("id").alias("change_id"), F.col("n").alias("incidents"), F.col("first").alias("first_incident"), F.col("total").alias("checksum"))


_SEVERITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(
    "a23_severity_pivot",
    "SELECT o_custkey, " + ", ".join(f"count(*) FILTER (WHERE o_orderpriority = '{s}') AS s{s[0]}" for s in _SEVERITIES) + " FROM orders GROUP BY o_custkey",
)
def severity_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = load(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderpriority", list(_SEVERITIES)).count().fillna(0)
    return wide.select("o_custkey", *(F.col(f"`{s}`").alias(f"s{s[0]}") for s in _SEVERITIES))


@query(
    "a24_review_stats_by_pair",
    """SELECT least(a.l_returnflag, b.l_returnflag) AS low, greatest(a.l_returnflag, b.l_returnflag) AS high, count(*) AS n, round(avg(CASE WHEN a.l_linestatus = b.l_linestatus THEN 1.0 ELSE 0.0 END), 6) AS accepted
       FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY 1, 2""",
)
def review_stats_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    a, b = lines.alias("a"), lines.alias("b")
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")))
    return pairs.groupBy(F.least("a.l_returnflag", "b.l_returnflag").alias("low"), F.greatest("a.l_returnflag", "b.l_returnflag").alias("high")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("a.l_linestatus") == F.col("b.l_linestatus")).cast("double")), 6).alias("accepted"))


@query(
    "a25_overview",
    "SELECT count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') AS urgent_open, count(DISTINCT o_custkey) AS customers FROM orders",
)
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_open = F.col("o_orderstatus") == "O"
    return load(spark, sf_dir, "orders").agg(F.count("*").alias("orders"), F.count_if(is_open).alias("open"), F.count_if(is_open & (F.col("o_orderpriority") == "1-URGENT")).alias("urgent_open"), F.countDistinct("o_custkey").alias("customers"))


@query(
    "a26_item_risk_score",
    """WITH t AS (SELECT l_partkey AS ci, CAST(l_orderkey % 1000 AS VARCHAR) AS thread, l_returnflag FROM lineitem)
       SELECT ci, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN thread END) AS incidents, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN thread END) AS alerts,
              CASE WHEN count(DISTINCT CASE WHEN l_returnflag = 'R' THEN thread END) >= 12 THEN 'high' WHEN count(DISTINCT CASE WHEN l_returnflag = 'R' THEN thread END) >= 6 THEN 'medium' ELSE 'low' END AS risk
       FROM t GROUP BY ci""",
)
def item_risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by kind, counted once for each thread (what stands before ':')."""
    thread = F.split(F.concat_ws(":", F.col("l_orderkey") % 1000, "l_linenumber"), ":")[0]
    marked = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ci"), thread.alias("thread"), "l_returnflag")
    of = lambda flag: F.countDistinct(F.when(F.col("l_returnflag") == flag, F.col("thread")))
    return marked.groupBy("ci").agg(of("R").alias("incidents"), of("A").alias("alerts")).withColumn("risk", F.when(F.col("incidents") >= 12, "high").when(F.col("incidents") >= 6, "medium").otherwise("low"))


@query(
    "a27_drift_alerts",
    """WITH m AS (SELECT max(ts) AS now FROM events),
            u AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN ts END) AS validated, count(*) FILTER (WHERE event_type = 'error' AND ts > now - INTERVAL 30 DAY) AS negative, max(ts) AS changed, max(now) AS now FROM events, m GROUP BY user_id)
       SELECT user_id, concat_ws(',', CASE WHEN validated IS NULL OR validated < now - INTERVAL 5 DAY THEN 'unvalidated' END, CASE WHEN negative >= 3 THEN 'negative_feedback' END, CASE WHEN changed > validated + INTERVAL 5 SECOND THEN 'pattern_newer' END) AS alerts FROM u""",
)
def drift_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    seen = events.join(F.broadcast(events.agg(F.max("ts").alias("now"))))
    by_user = seen.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("validated"), F.count_if((F.col("event_type") == "error") & (F.col("ts") > F.col("now") - F.expr("INTERVAL 30 DAY"))).alias("negative"), F.max("ts").alias("changed"), F.max("now").alias("now"))
    stale = F.when(F.col("validated").isNull() | (F.col("validated") < F.col("now") - F.expr("INTERVAL 5 DAY")), "unvalidated")
    return by_user.select("user_id", F.concat_ws(",", stale, F.when(F.col("negative") >= 3, "negative_feedback"), F.when(F.col("changed") > F.col("validated") + F.expr("INTERVAL 5 SECOND"), "pattern_newer")).alias("alerts"))


@query("a28_drifting_knowledge", f"SELECT pattern_id, success_rate, successes + failures AS n FROM ({_EFFICACY}) WHERE success_rate < 0.5 AND successes + failures >= 5 ORDER BY success_rate, n DESC, pattern_id LIMIT 20")
def drifting_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("successes") + F.col("failures")
    return efficacy(load(spark, sf_dir, "events")).where((F.col("success_rate") < 0.5) & (n >= 5)).select("pattern_id", "success_rate", n.alias("n")).orderBy("success_rate", F.desc("n"), "pattern_id").limit(20)


@query("a29_counts_by_two_keys", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def counts_by_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query(
    "a30_coverage_ladder",
    """WITH c AS (SELECT source, count(*) AS items, count(*) FILTER (WHERE text <> '') AS with_text, count(quality) AS labelled, count(*) FILTER (WHERE quality = 1) AS good
                  FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY source)
       SELECT source, items, labelled, CASE WHEN items = 0 THEN 'empty' WHEN with_text = 0 THEN 'no_text' WHEN labelled = 0 THEN 'unlabelled' WHEN labelled * 4 < items THEN 'sparse'
              WHEN good = 0 THEN 'all_bad' WHEN good * 2 < labelled THEN 'weak' WHEN labelled = items THEN 'complete' ELSE 'covered' END AS status FROM c""",
)
def coverage_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = load(spark, sf_dir, "documents").join(labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("items"), F.count_if(F.col("text") != "").alias("with_text"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"))
    status = F.when(F.col("items") == 0, "empty").when(F.col("with_text") == 0, "no_text").when(F.col("labelled") == 0, "unlabelled").when(F.col("labelled") * 4 < F.col("items"), "sparse").when(F.col("good") == 0, "all_bad").when(F.col("good") * 2 < F.col("labelled"), "weak").when(F.col("labelled") == F.col("items"), "complete").otherwise("covered")
    return counts.select("source", "items", "labelled", status.alias("status"))


@query(
    "a31_trust_ladder",
    """WITH s AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS ok FROM events GROUP BY user_id),
            b AS (SELECT user_id, n, ok, ((ok / n) + 3.8416 / (2 * n) - 1.96 * sqrt((ok / n) * (1 - ok / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n) AS bound FROM s)
       SELECT user_id, n, ok, round(bound, 6) AS bound, CASE WHEN n = 0 THEN 'advisory' WHEN bound >= 0.9 THEN 'autonomous' WHEN bound >= 0.5 THEN 'supervised' ELSE 'advisory' END AS level FROM b""",
)
def trust_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("ok"))
    bound = wilson_lower(F.col("ok"), F.col("n"))
    return counts.select("user_id", "n", "ok", F.round(bound, 6).alias("bound"), trust_level(F.col("n"), bound).alias("level"))


@query(
    "a33_arm_weights",
    """WITH a AS (SELECT event_type AS arm, count(*) AS n, avg(CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0.0 END) AS hit FROM events GROUP BY 1), m AS (SELECT avg(CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0.0 END) AS base, count(*) AS total FROM events)
       SELECT arm, n, round(CASE WHEN total < 120 THEN 1.0 ELSE least(2.0, greatest(0.05, 1.0 + least(0.25, greatest(-0.25, hit - base)))) END, 6) AS weight FROM a, m""",
)
def arm_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New weight of each arm: at most 0.25 from 1, within [0.05, 2]; unchanged below 120 labels."""
    events = load(spark, sf_dir, "events").withColumn("y", (F.col("user_id") % 2 == 0).cast("double"))
    base = events.agg(F.avg("y").alias("base"), F.count("*").alias("total"))
    arms = events.groupBy(F.col("event_type").alias("arm")).agg(F.count("*").alias("n"), F.avg("y").alias("hit")).join(F.broadcast(base))
    step = F.least(F.lit(0.25), F.greatest(F.lit(-0.25), F.col("hit") - F.col("base")))
    return arms.select("arm", "n", F.round(F.when(F.col("total") < 120, F.lit(1.0)).otherwise(F.least(F.lit(2.0), F.greatest(F.lit(0.05), 1.0 + step))), 6).alias("weight"))


@query("a34_min_by_parent", "SELECT l_orderkey AS parent, min(l_discount) AS distance FROM lineitem GROUP BY 1")
def min_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("parent")).agg(F.min("l_discount").alias("distance"))


@query("a35_cluster_span", "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, date_diff('second', min(ts), max(ts)) >= 1800 AS overdue FROM events GROUP BY user_id")
def cluster_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.timestamp_diff("SECOND", F.date_trunc("second", F.min("ts")), F.date_trunc("second", F.max("ts")))
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), (span >= 1800).alias("overdue"))


@query("a36_next_number", "SELECT r_regionkey, coalesce(max(n_nationkey), 0) + 1 AS next_number FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def next_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = load(spark, sf_dir, "region").join(load(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return joined.groupBy("r_regionkey").agg((F.coalesce(F.max("n_nationkey"), F.lit(0)) + 1).alias("next_number"))


@query(
    "a37_duplicate_groups",
    """SELECT lower(p_name) AS title, p_type, count(*) AS members, min(p_partkey) AS canonical FROM part GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("title"), "p_type").agg(F.count("*").alias("members"), F.min("p_partkey").alias("canonical")).where("members > 1")


@query(
    "a38_review_badge",
    f"SELECT pattern_id, CASE WHEN success_rate IS NULL THEN 'grey' WHEN success_rate > 0.8 THEN 'green' WHEN success_rate >= 0.5 THEN 'amber' ELSE 'red' END AS badge FROM ({_EFFICACY})",
)
def review_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.col("success_rate")
    return efficacy(load(spark, sf_dir, "events")).select("pattern_id", F.when(rate.isNull(), "grey").when(rate > 0.8, "green").when(rate >= 0.5, "amber").otherwise("red").alias("badge"))


@query(
    "sc09_alert_rollup",
    """SELECT user_id AS ci, strftime(ts, '%Y-%m-%d') AS day, count(*) AS alerts, min(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 + 1) AS worst, min(ts) AS first_ts, max(ts) AS last_ts,
              concat('em_alert_rollup:', user_id, ':', strftime(ts, '%Y-%m-%d')) AS key, """
    + ", ".join(f"count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 + 1 = {s}) AS sev{s}" for s in range(1, 6))
    + " FROM events GROUP BY 1, 2",
)
def alert_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of an item and day: count, worst (least) severity, severity histogram, first and last time."""
    severity = _k() % 5 + 1
    alerts = load(spark, sf_dir, "events").select(F.col("user_id").alias("ci"), F.date_format("ts", "yyyy-MM-dd").alias("day"), severity.alias("sev"), "ts")
    rolled = alerts.groupBy("ci", "day").agg(F.count("*").alias("alerts"), F.min("sev").alias("worst"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *(F.count_if(F.col("sev") == s).alias(f"sev{s}") for s in range(1, 6)))
    return rolled.withColumn("key", F.concat_ws(":", F.lit("em_alert_rollup"), "ci", "day"))
