"""Predicates, joins, windows, sorts, set operations and table changes (sinks)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.predicates import RISK_RANK, excluded_free, risk_rank, strict_scope, open_scope, valid_at
from tessera.operators.tables import close_and_replace, global_rank, insert_missing, latest_per_key, new_rows_by_hash, orphans
from tessera.plans.registry import load, query


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("long")


_JK = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

# -- predicates ----------------------------------------------------------------


@query("pf01_visibility", "SELECT doc_id, source FROM documents WHERE (source IS NULL OR source NOT IN ('src1', 'src2')) AND (lang IS NULL OR lang <> 'fr')")
def visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").where(excluded_free("source", ["src1", "src2"]) & excluded_free("lang", ["fr"])).select("doc_id", "source")


@query("pf02_policy_exclusion", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def policy_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    restricted = load(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return load(spark, sf_dir, "customer").join(restricted, "c_nationkey", "left_anti").select("c_custkey")


@query(
    "pf03_domain_scope",
    """SELECT 'open' AS scope, count(*) AS n FROM (SELECT nullif(lang, 'es') AS domain FROM documents) WHERE domain = 'en' OR domain IS NULL UNION ALL
       SELECT 'strict', count(*) FROM (SELECT nullif(lang, 'es') AS domain FROM documents) WHERE domain = 'en' UNION ALL
       SELECT 'strict_null', count(*) FROM (SELECT nullif(lang, 'es') AS domain FROM documents) WHERE domain IS NULL""",
)
def domain_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.nullif("lang", F.lit("es")).alias("domain"))
    kinds = F.array(F.struct(F.lit("open").alias("scope"), open_scope("domain", "en").alias("hit")), F.struct(F.lit("strict").alias("scope"), strict_scope("domain", "en").alias("hit")), F.struct(F.lit("strict_null").alias("scope"), strict_scope("domain", None).alias("hit")))
    return docs.select(F.explode(kinds).alias("s")).groupBy("s.scope").agg(F.count_if("s.hit").alias("n"))


@query(
    "pf04_risk_cap",
    "SELECT o_orderkey, coalesce(map_extract(MAP {" + ", ".join(f"'{k}': {v}" for k, v in RISK_RANK.items()) + "}, lower(trim(split_part(o_orderpriority, '-', 2))))[1], 2) AS rank FROM orders WHERE coalesce(map_extract(MAP {" + ", ".join(f"'{k}': {v}" for k, v in RISK_RANK.items()) + "}, lower(trim(split_part(o_orderpriority, '-', 2))))[1], 2) <= 2",
)
def risk_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = risk_rank(F.split("o_orderpriority", "-")[1])
    return load(spark, sf_dir, "orders").where(rank <= 2).select("o_orderkey", rank.alias("rank"))


@query(
    "pf05_as_of",
    """WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderdate AS valid_from, CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS valid_to FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM e WHERE valid_from <= TIMESTAMP '1998-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1998-01-01')""",
)
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = edges.withColumnRenamed("o_orderdate", "valid_from").withColumn("valid_to", F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")))
    return edges.where(valid_at(F.lit("1998-01-01").cast("timestamp_ntz"))).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("pf06_substring_search", "SELECT p_partkey FROM part WHERE p_name ILIKE '%RING%' OR p_type ILIKE '%eco%' OR p_brand ILIKE '%#1'")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").where(F.col("p_name").ilike("%RING%") | F.col("p_type").ilike("%eco%") | F.col("p_brand").ilike("%#1")).select("p_partkey")


@query("pf07_case_insensitive_equality", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def case_insensitive_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").where(F.lower("c_mktsegment") == "building").select("c_custkey")


@query("pf08_in_lists", "SELECT event_id FROM events WHERE event_type IN ('error', 'view') AND user_id NOT IN (1, 2, 3) AND nullif(value, 1.0) IS DISTINCT FROM NULL")
def in_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").where(F.col("event_type").isin("error", "view") & ~F.col("user_id").isin(1, 2, 3) & ~F.nullif("value", F.lit(1.0)).eqNullSafe(F.lit(None))).select("event_id")


@query("pf09_tuple_in", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT p_partkey, p_partkey % 10 FROM part WHERE p_size > 25)")
def tuple_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = load(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 10).alias("l_suppkey"))
    return load(spark, sf_dir, "lineitem").join(wanted, ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("pf10_json_containment", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '42'")
def json_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").where(F.get_json_object("props", "$.k") == "42").select("event_id")


@query(
    "pf11_contained_by",
    """WITH s AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS ids FROM events GROUP BY user_id)
       SELECT user_id, len(ids) AS n FROM s WHERE list_has_all(['click', 'error', 'purchase', 'signup', 'view'], ids) ORDER BY n DESC, user_id LIMIT 1""",
)
def contained_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = load(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("ids"))
    wanted = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    return sets.where(F.size(F.array_except("ids", wanted)) == 0).select("user_id", F.size("ids").cast("long").alias("n")).orderBy(F.desc("n"), "user_id").limit(1)


@query("pf12_json_key_presence", "SELECT count(*) FILTER (WHERE json_exists(props, '$.k')) AS with_k, count(*) FILTER (WHERE json_exists(props, '$.other')) AS with_other FROM events")
def json_key_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda key: F.count_if(F.get_json_object("props", f"$.{key}").isNotNull())
    return load(spark, sf_dir, "events").agg(has("k").alias("with_k"), has("other").alias("with_other"))


@query("pf13_hash_sharding", "SELECT event_id, CAST(concat('0x', substr(md5(CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT) % 8 AS shard FROM events")
def hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every row, by a hash that other systems can compute as well."""
    return load(spark, sf_dir, "events").select("event_id", F.pmod(F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(8)).alias("shard"))


@query(
    "pf14_review_priority",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 40 ELSE 0 END + CASE WHEN o_orderstatus = 'O' THEN 20 ELSE 0 END + 3 * least(coalesce(n, 0), 10) + round(10 * least(o_totalprice / 400000, 1.0), 4) AS priority
       FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def review_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = load(spark, sf_dir, "orders").join(evidence, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    score = F.when(F.col("o_orderpriority") == "1-URGENT", 40).otherwise(0) + F.when(F.col("o_orderstatus") == "O", 20).otherwise(0) + 3 * F.least(F.coalesce("n", F.lit(0)), F.lit(10)) + F.round(10 * F.least(F.col("o_totalprice") / 400000, F.lit(1.0)), 4)
    return orders.select("o_orderkey", score.alias("priority"))


@query("pf16_filter_before_limit", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def filter_before_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query(
    "pf17_quality_gate",
    """WITH a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
       SELECT c_custkey FROM customer LEFT JOIN a ON a.user_id = c_custkey AND rn = 1 WHERE event_type IS NULL OR event_type NOT IN ('error', 'view')""",
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest assessment must not be a failing one; none at all never excludes."""
    latest = latest_per_key(load(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type")
    return load(spark, sf_dir, "customer").join(latest, F.col("user_id") == F.col("c_custkey"), "left").where(excluded_free("event_type", ["error", "view"])).select("c_custkey")


@query("pf18_pagination", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100")
def pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", "ts").orderBy(F.desc("ts"), "event_id").offset(100).limit(50)


# -- joins ---------------------------------------------------------------------


@query("j01_inner_chain", "SELECT r_name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def inner_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: load(spark, sf_dir, name)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.count("*").alias("orders"))


@query("j02_left_outer", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").join(load(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query(
    "j03_both_ends",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p.p_name AS low_name, s.s_name AS high_name FROM lineitem LEFT JOIN part p ON p.p_partkey = l_partkey LEFT JOIN supplier s ON s.s_suppkey = l_suppkey",
)
def both_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = load(spark, sf_dir, "part").alias("p"), load(spark, sf_dir, "supplier").alias("s")
    lines = load(spark, sf_dir, "lineitem")
    return lines.join(p, F.col("p.p_partkey") == F.col("l_partkey"), "left").join(s, F.col("s.s_suppkey") == F.col("l_suppkey"), "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("p.p_name").alias("low_name"), F.col("s.s_name").alias("high_name"))


@query("j04_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return load(spark, sf_dir, "customer").join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("j05_anti_join", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query(
    "j07_co_occurrence",
    """WITH d AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
       SELECT a.l_suppkey AS low, b.l_suppkey AS high, count(*) AS n, round(least(0.3 + 0.1 * (count(*) - 3), 0.7), 4) AS confidence FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey
       GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY n DESC, low, high LIMIT 200""",
)
def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The pairs of an order come from its own list, one element after another, so nothing is joined.
    lists = load(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s")).where(F.size("s") > 1)
    each = lists.select("s", F.posexplode("s").alias("i", "low")).select("low", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("high"))
    pairs = each.groupBy("low", "high").agg(F.count("*").alias("n"))
    return pairs.where("n >= 3").withColumn("confidence", F.round(F.least(0.3 + 0.1 * (F.col("n") - 3), F.lit(0.7)), 4)).orderBy(F.desc("n"), "low", "high").limit(200)


@query(
    "j08_as_of_prior",
    """WITH p AS (SELECT event_id, ts, lag(event_id) OVER w AS prior, lag(ts) OVER w AS prior_ts FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
       SELECT event_id, CASE WHEN prior_ts >= ts - INTERVAL 2 DAY THEN prior END AS prior FROM p""",
)
def as_of_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest earlier row of the same key, if it is at most two days old: one sort, no range join."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    seen = load(spark, sf_dir, "events").select("event_id", "ts", F.lag("event_id").over(w).alias("prior"), F.lag("ts").over(w).alias("prior_ts"))
    return seen.select("event_id", F.when(F.col("prior_ts") >= F.col("ts") - F.expr("INTERVAL 2 DAY"), F.col("prior")).alias("prior"))


@query(
    "j09_interval_join",
    f"""SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND {_JK.replace('props', 'a.props')} = {_JK.replace('props', 'b.props')} AND a.event_id < b.event_id
        AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 86400000000""",
)
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("event_id", "user_id", _k().alias("k"), "ts")
    a, b = events.alias("a"), events.alias("b")
    near = (F.col("b.ts") <= F.col("a.ts") + F.expr("INTERVAL 1 DAY")) & (F.col("b.ts") >= F.col("a.ts") - F.expr("INTERVAL 1 DAY"))
    return a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.event_id") < F.col("b.event_id")) & near).select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"))


@query(
    "j10_nearest_seed",
    """WITH s AS (SELECT user_id, ts FROM events WHERE event_type = 'signup'),
            g AS (SELECT e.event_id, min(abs(date_diff('second', date_trunc('second', e.ts), date_trunc('second', s.ts)))) AS gap FROM events e LEFT JOIN s ON s.user_id = e.user_id WHERE e.event_type = 'error' GROUP BY 1)
       SELECT event_id, coalesce(gap <= 43200, true) AS kept FROM g""",
)
def nearest_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within twelve hours of the nearest seed of the same key; without a seed it passes."""
    events = load(spark, sf_dir, "events")
    seeds = events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("seed_ts"))
    gap = F.abs(F.timestamp_diff("SECOND", F.date_trunc("second", "ts"), F.date_trunc("second", "seed_ts")))
    return events.where("event_type = 'error'").join(seeds, "user_id", "left").groupBy("event_id").agg(F.min(gap).alias("gap")).select("event_id", F.coalesce(F.col("gap") <= 43200, F.lit(True)).alias("kept"))


@query(
    "j11_set_overlap",
    """SELECT a.l_orderkey AS a, b.l_orderkey AS b, count(DISTINCT a.l_partkey) AS shared FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_orderkey < b.l_orderkey GROUP BY 1, 2 HAVING count(DISTINCT a.l_partkey) >= 2""",
)
def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.dedup import overlaps

    return overlaps(load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("item")))


@query(
    "j12_containment_join",
    """WITH s AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS x FROM lineitem), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
            c AS (SELECT a.id AS small, b.id AS large, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.id <> b.id GROUP BY 1, 2)
       SELECT DISTINCT small AS retired FROM c JOIN n na ON na.id = small JOIN n nb ON nb.id = large WHERE common = na.n AND (nb.n > na.n OR large < small)""",
)
def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets that another set contains (of equal ones all but the first): containment is transitive, so no greedy pass is needed."""
    from tessera.operators.dedup import contained_sets

    return contained_sets(load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("item"))).select(F.col("id").alias("retired"))


@query(
    "j13_feedback_in_results",
    """WITH r AS (SELECT l_orderkey, list({'id': l_partkey, 'score': l_discount} ORDER BY l_linenumber, l_partkey, l_suppkey) AS ranked FROM lineitem GROUP BY 1),
            x AS (SELECT l_orderkey, unnest(ranked) AS r FROM r)
       SELECT o_orderkey, round(max(x.r.score), 6) AS score FROM orders JOIN x ON x.l_orderkey = o_orderkey WHERE x.r.id % 5 = o_custkey % 5 GROUP BY o_orderkey""",
)
def feedback_in_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("id"), F.col("l_discount").alias("score"))).alias("ranked"))
    rows = load(spark, sf_dir, "orders").join(records, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", F.explode("ranked").alias("r"))
    return rows.where(F.col("r.id") % 5 == F.col("o_custkey") % 5).groupBy("o_orderkey").agg(F.round(F.max("r.score"), 6).alias("score"))


@query(
    "j14_polymorphic_key",
    """WITH e AS (SELECT 'part' AS kind, l_partkey AS id FROM lineitem UNION ALL SELECT 'supplier', l_suppkey FROM lineitem),
            d AS (SELECT 'part' AS kind, p_partkey AS id, p_name AS title FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier)
       SELECT kind, id, title, count(*) AS n FROM e JOIN d USING (kind, id) GROUP BY 1, 2, 3""",
)
def polymorphic_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    ends = lines.select(F.explode(F.array(F.struct(F.lit("part").alias("kind"), F.col("l_partkey").alias("id")), F.struct(F.lit("supplier").alias("kind"), F.col("l_suppkey").alias("id")))).alias("e")).select("e.*")
    names = load(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title")).unionByName(load(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("title")))
    return ends.groupBy("kind", "id").agg(F.count("*").alias("n")).join(names, ["kind", "id"]).select("kind", "id", "title", "n")


@query("j15_term_resolution", "SELECT p_name AS term, count(*) AS matches, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS resolved, count(*) > 1 AS ambiguous FROM part GROUP BY 1")
def term_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").groupBy(F.col("p_name").alias("term")).agg(F.count("*").alias("matches"), F.when(F.count("*") == 1, F.min("p_partkey")).alias("resolved"), (F.count("*") > 1).alias("ambiguous"))


_TOKENS = ("RING", "bolt", "Wid", "#12")


@query("j16_token_search", "SELECT p_partkey FROM part WHERE " + " OR ".join(f"contains(lower(concat_ws(' ', p_name, p_brand)), '{t.lower()}')" for t in _TOKENS))
def token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, hit = F.lower(F.concat_ws(" ", "p_name", "p_brand")), F.lit(False)
    for token in _TOKENS:
        hit = hit | text.contains(token.lower())
    return load(spark, sf_dir, "part").where(hit).select("p_partkey")


# -- windows -------------------------------------------------------------------


@query(
    "w01_edge_budget",
    """WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem)
       SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM r WHERE rn <= 20 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 500""",
)
def edge_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest edges of each node, then the heaviest of all."""
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"]
    rn = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order))
    return load(spark, sf_dir, "lineitem").withColumn("rn", rn).where("rn <= 20").orderBy(*order, "l_suppkey").limit(500).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query("w02_latest_version", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F')::INT DESC, o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_per_key(load(spark, sf_dir, "orders"), ["o_custkey"], [F.desc(F.col("o_orderstatus") == "F"), F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("w03_latest_checkpoint", "SELECT user_id, arg_max(event_id, {'t': ts, 'i': event_id}) AS checkpoint FROM events GROUP BY user_id")
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("checkpoint"))


@query(
    "w04_score_margin",
    "SELECT o_custkey, o_orderkey, round(o_totalprice - coalesce(nxt, 0), 4) AS margin FROM (SELECT *, lead(o_totalprice) OVER w AS nxt, row_number() OVER w AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) WHERE rn = 1",
)
def score_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best score less the second; a single score is its own margin."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = load(spark, sf_dir, "orders").withColumn("nxt", F.lead("o_totalprice").over(w)).withColumn("rn", F.row_number().over(w))
    return ranked.where("rn = 1").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") - F.coalesce("nxt", F.lit(0.0)), 4).alias("margin"))


@query("w05_reciprocal_rank", "SELECT o_orderkey, round(1.0 / row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), 6) AS rr FROM orders")
def reciprocal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(1.0 / F.row_number().over(w), 6).alias("rr"))


@query(
    "w07_days_since_prior",
    """WITH p AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prior FROM events)
       SELECT event_id, CAST(date_diff('second', date_trunc('second', prior), date_trunc('second', ts)) // 86400 AS BIGINT) AS days, CASE WHEN prior IS NULL THEN 'first_seen' WHEN date_diff('second', date_trunc('second', prior), date_trunc('second', ts)) > 604800 THEN 'returned' ELSE 'recurring' END AS label FROM p""",
)
def days_since_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    seconds = F.timestamp_diff("SECOND", F.date_trunc("second", "prior"), F.date_trunc("second", "ts"))
    seen = load(spark, sf_dir, "events").select("event_id", "ts", F.lag("ts").over(w).alias("prior")).withColumn("s", seconds)
    return seen.select("event_id", F.expr("s div 86400").alias("days"), F.when(F.col("prior").isNull(), "first_seen").when(F.col("s") > 604800, "returned").otherwise("recurring").alias("label"))


@query(
    "w08_failure_streak",
    """WITH g AS (SELECT user_id, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
            s AS (SELECT user_id, island, count(*) FILTER (WHERE event_type IN ('error', 'view')) AS streak FROM g GROUP BY 1, 2)
       SELECT user_id, max(streak) AS longest, arg_max(streak, island) AS current, arg_max(streak, island) >= 3 AS suspended FROM s GROUP BY 1""",
)
def failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A success starts a new island; failures and inconclusive outcomes count in it; three suspend."""
    island = F.sum((F.col("event_type") == "purchase").cast("int")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    streaks = load(spark, sf_dir, "events").withColumn("island", island).groupBy("user_id", "island").agg(F.count_if(F.col("event_type").isin("error", "view")).alias("streak"))
    return streaks.groupBy("user_id").agg(F.max("streak").alias("longest"), F.max_by("streak", "island").alias("current"), (F.max_by("streak", "island") >= 3).alias("suspended"))


@query(
    "w09_overlapping_batches",
    """WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer),
            b AS (SELECT c_nationkey, c_custkey, unnest(range(greatest(0, (i - 60 + 50) // 50), i // 50 + 1)) AS batch, i FROM r)
       SELECT c_nationkey, batch, count(*) AS n, min(c_custkey) AS first_id FROM b WHERE i >= batch * 50 AND i < batch * 50 + 60 GROUP BY 1, 2""",
)
def overlapping_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 60 that overlap by 10."""
    i = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    placed = load(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", i.cast("long").alias("i"))
    batches = placed.withColumn("batch", F.explode(F.sequence(F.greatest(F.lit(0), F.expr("(i - 10) div 50")).cast("long"), F.expr("i div 50"))))
    return batches.where("i >= batch * 50 AND i < batch * 50 + 60").groupBy("c_nationkey", "batch").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_id"))


@query(
    "w10_trailing_windows",
    "SELECT " + ", ".join(f"count(*) FILTER (WHERE ts > now - INTERVAL {n} {u}) AS last_{n}_{u.lower()}" for n, u in ((10, "MINUTE"), (60, "MINUTE"), (7, "DAY"), (30, "DAY"), (180, "DAY"))) + " FROM events, (SELECT max(ts) AS now FROM events)",
)
def trailing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    seen = events.join(F.broadcast(events.agg(F.max("ts").alias("now"))))
    return seen.agg(*(F.count_if(F.col("ts") > F.col("now") - F.expr(f"INTERVAL {n} {u}")).alias(f"last_{n}_{u.lower()}") for n, u in ((10, "MINUTE"), (60, "MINUTE"), (7, "DAY"), (30, "DAY"), (180, "DAY"))))


# -- sorts and set operations --------------------------------------------------


@query("t06_titles_sorted", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%bolt%' ORDER BY coalesce(p_retailprice, 0) DESC, p_partkey LIMIT 50 OFFSET 10")
def titles_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").where(F.col("p_name").ilike("%bolt%")).orderBy(F.coalesce("p_retailprice", F.lit(0.0)).desc(), "p_partkey").offset(10).limit(50).select("p_partkey", "p_name")


@query("t07_ingest_priority", "SELECT conv_id, count(*) AS turns, max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS has_resolution FROM conversations GROUP BY conv_id")
def ingest_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All threads, those with a resolution and many turns first."""
    threads = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max((F.col("role") == "system").cast("int")).alias("has_resolution"))
    return threads.orderBy(F.desc("has_resolution"), F.desc("turns"), "conv_id")


@query(
    "t08_neighbour_budget",
    """WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rn, count(*) OVER (PARTITION BY src) AS n FROM e)
       SELECT src, dst, n > 250 AS truncated FROM r WHERE rn <= 250""",
)
def neighbour_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest neighbours of each node, 250 at most (each brings one edge, so 500 edges are never met), and whether there are more."""
    edges = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.sum("l_quantity").alias("weight"))
    degrees = edges.groupBy("src").agg((F.count("*") > 250).alias("truncated"))
    best = edges.withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))).where("rn <= 250")
    return best.join(degrees, "src").select("src", "dst", "truncated")


@query(
    "t09_null_placement",
    "SELECT o_custkey, row_number() OVER (ORDER BY late ASC NULLS LAST, o_custkey) AS rank_asc, row_number() OVER (ORDER BY late DESC NULLS FIRST, o_custkey) AS rank_desc FROM (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'O' THEN o_orderdate END) AS late FROM orders GROUP BY 1)",
)
def null_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of every customer by the last open order, customers without one last or first."""
    late = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate"))).alias("late"))
    up = global_rank(late, (F.asc_nulls_last("late"), F.asc_nulls_last("o_custkey")), "rank_asc")
    return global_rank(up, (F.desc_nulls_first("late"), F.asc_nulls_last("o_custkey")), "rank_desc").select("o_custkey", "rank_asc", "rank_desc")


@query(
    "t09_null_placement_all",
    "SELECT o_custkey, row_number() OVER (ORDER BY late ASC NULLS LAST, o_custkey) AS rank_asc, row_number() OVER (ORDER BY late DESC NULLS FIRST, o_custkey) AS rank_desc FROM (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN o_orderdate END) AS late FROM orders GROUP BY 1)",
)
def null_placement_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by urgent orders only."""
    late = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT"), F.col("o_orderdate"))).alias("late"))
    up = global_rank(late, (F.asc_nulls_last("late"), F.asc_nulls_last("o_custkey")), "rank_asc")
    return global_rank(up, (F.desc_nulls_first("late"), F.asc_nulls_last("o_custkey")), "rank_desc").select("o_custkey", "rank_asc", "rank_desc")


@query("s01_union_all", "SELECT l_partkey AS id FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_partkey").alias("id")).unionByName(lines.select(F.col("l_suppkey").alias("id")))


@query("s03_set_algebra", "SELECT a.user_id, len(list_intersect(a.t, b.t)) AS common, len(list_filter(a.t, lambda x: NOT list_contains(b.t, x))) AS only_a FROM (SELECT user_id, list_distinct(list(event_type)) AS t FROM events WHERE value > 40 GROUP BY 1) a JOIN (SELECT user_id, list_distinct(list(event_type)) AS t FROM events WHERE value <= 5 GROUP BY 1) b USING (user_id)")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    a = events.where("value > 40").groupBy("user_id").agg(F.collect_set("event_type").alias("a"))
    b = events.where("value <= 5").groupBy("user_id").agg(F.collect_set("event_type").alias("b"))
    return a.join(b, "user_id").select("user_id", F.size(F.array_intersect("a", "b")).cast("long").alias("common"), F.size(F.array_except("a", "b")).cast("long").alias("only_a"))


@query("s04_ordered_distinct", "WITH f AS (SELECT user_id, event_type, min({'t': ts, 'i': event_id}) AS first_at FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY first_at) AS kinds FROM f GROUP BY 1")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values in the order of their first occurrence."""
    first = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds"))


@query("s05_select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def select_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query(
    "s06_state_diff",
    """WITH o AS (SELECT event_id, user_id, event_type AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS val, lag(CAST(json_extract_string(props, '$.k') AS BIGINT)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS old FROM events)
       SELECT event_id, key, old AS from_value, val AS to_value FROM o WHERE old IS DISTINCT FROM val""",
)
def state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, from, to) of each change of a keyed state."""
    old = F.lag(_k()).over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    seen = load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("key"), old.alias("from_value"), _k().alias("to_value"))
    return seen.where(~F.col("from_value").eqNullSafe(F.col("to_value")))


# -- table changes -------------------------------------------------------------


@query(
    "sk01_landing_dedup",
    """WITH h AS (SELECT doc_id, source, md5(text) AS content_hash FROM documents), f AS (SELECT source, content_hash, min(doc_id) AS doc_id FROM h WHERE doc_id % 10 > 2 GROUP BY 1, 2)
       SELECT count(*) FILTER (WHERE NOT seen) AS created, (SELECT count(*) FROM h WHERE doc_id % 10 > 2) - count(*) FILTER (WHERE NOT seen) AS skipped
       FROM (SELECT f.*, EXISTS (SELECT 1 FROM h WHERE h.doc_id % 10 <= 2 AND h.source = f.source AND h.content_hash = f.content_hash) AS seen FROM f)""",
)
def landing_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch lands: rows whose content hash is new to their source are created, the others skipped."""
    hashed = load(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("content_hash"))
    batch, existing = hashed.where("doc_id % 10 > 2"), hashed.where("doc_id % 10 <= 2")
    created = new_rows_by_hash(batch, existing, ["source", "content_hash"], "doc_id").agg(F.count("*").alias("created"))
    return created.join(batch.agg(F.count("*").alias("n"))).select("created", (F.col("n") - F.col("created")).alias("skipped"))


@query("sk02_blob_offload", "SELECT doc_id, n_chars > 4000 AS offloaded, CASE WHEN n_chars > 4000 THEN NULL ELSE text END AS payload, octet_length(encode(text)) AS size_bytes FROM documents")
def blob_offload(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = F.length("text") > 4000
    return load(spark, sf_dir, "documents").select("doc_id", big.alias("offloaded"), F.when(~big, F.col("text")).alias("payload"), F.octet_length("text").cast("long").alias("size_bytes"))


_LOGICAL = ["l_orderkey", "l_partkey"]


@query(
    "sk03_edge_upsert",
    """WITH a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'N'), n AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'N')
       SELECT l_orderkey, l_partkey, 'kept' AS origin FROM a UNION ALL SELECT l_orderkey, l_partkey, 'added' FROM n WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.l_orderkey = n.l_orderkey AND a.l_partkey = n.l_partkey)""",
)
def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert edges that have no active row with the same logical key."""
    lines = load(spark, sf_dir, "lineitem")
    active = lines.where("l_returnflag = 'N'").select(*_LOGICAL).distinct().withColumn("origin", F.lit("kept"))
    coming = lines.where("l_returnflag <> 'N'").select(*_LOGICAL).withColumn("origin", F.lit("added"))
    return insert_missing(active, coming, _LOGICAL)


@query(
    "sk04_scd2_replace",
    """WITH cur AS (SELECT o_custkey, max(o_orderkey) AS version FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), new AS (SELECT o_custkey, max(o_orderkey) AS version FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
       SELECT cur.o_custkey, cur.version, TIMESTAMP '2000-01-01' AS valid_from, CASE WHEN new.version IS NOT NULL THEN TIMESTAMP '2001-01-01' END AS valid_to FROM cur LEFT JOIN new USING (o_custkey)
       UNION ALL SELECT o_custkey, version, TIMESTAMP '2001-01-01', NULL FROM new""",
)
def scd2_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    newest = lambda parity: orders.where(F.col("o_orderkey") % 2 == parity).groupBy("o_custkey").agg(F.max("o_orderkey").alias("version"))
    stamp = lambda day: F.lit(day).cast("timestamp_ntz")
    current = newest(0).withColumns({"valid_from": stamp("2000-01-01"), "valid_to": F.lit(None).cast("timestamp_ntz")})
    return close_and_replace(current, newest(1), ["o_custkey"], stamp("2001-01-01"))


@query("sk06_budget_upsert", "SELECT c_custkey AS tenant, coalesce(n.used, c_custkey % 7) AS used FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS used FROM orders GROUP BY 1) n ON n.o_custkey = c_custkey")
def budget_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("tenant")).agg(F.count("*").alias("new"))
    old = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tenant"), (F.col("c_custkey") % 7).alias("old"))
    return old.join(new, "tenant", "left").select("tenant", F.coalesce("new", "old").alias("used"))


@query("sk08_bulk_expire", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1999-01-01' THEN 'expired' ELSE o_orderstatus END AS state FROM orders")
def bulk_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.when(old, "expired").otherwise(F.col("o_orderstatus")).alias("state"))


@query("sk09_purge_dry_run", "SELECT o_orderstatus AS class, count(*) AS would_purge FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def purge_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return load(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").groupBy(F.col("o_orderstatus").alias("class")).agg(F.count("*").alias("would_purge"))


@query("sk10_orphan_sweep", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def orphan_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = load(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return orphans(load(spark, sf_dir, "lineitem"), kept, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")
