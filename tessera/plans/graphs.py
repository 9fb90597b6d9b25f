"""Graph, clustering, dedup and lifecycle pipelines over edges made from orders, parts, suppliers and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.graph import ancestor_chains, decay_expand, decision_chains, neighbours
from tessera.operators.situations import correlate
from tessera.plans.registry import load, query

#: Edges supplier - part, supplier nodes as negative numbers.
_EDGES = "SELECT DISTINCT -1 - l_suppkey AS src, l_partkey AS dst, round(0.2 + (l_partkey % 8) / 10.0, 2) AS weight FROM lineitem"


def supply_edges(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    edges = lines.select((-1 - F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst"), F.round(0.2 + (F.col("l_partkey") % 8) / 10.0, 2).alias("weight"))
    return edges.distinct() if once else edges


@query(
    "g01_neighbours",
    f"""WITH RECURSIVE e AS ({_EDGES}), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), b(node, depth) AS (SELECT CAST(-1 AS BIGINT), 0 UNION SELECT u.dst, b.depth + 1 FROM b JOIN u ON u.src = b.node WHERE b.depth < 2)
        SELECT node, min(depth) AS depth FROM b GROUP BY node""",
)
def near_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([(-1,)], "node long")
    return neighbours(supply_edges(spark, sf_dir), seeds, 2).select("node", "depth")


@query(
    "g02_pattern_subgraph",
    f"""WITH e AS ({_EDGES}), h1 AS (SELECT dst AS node, weight FROM e WHERE src = -1), n AS (SELECT CAST(-1 AS BIGINT) AS node, 0 AS depth, CAST(9 AS DOUBLE) AS best UNION ALL SELECT node, 1, weight FROM h1 UNION ALL SELECT src, 2, max(e.weight) FROM e JOIN h1 ON h1.node = e.dst WHERE src <> -1 GROUP BY 1),
        k AS (SELECT node FROM n ORDER BY depth, best DESC, node LIMIT 250), a AS (SELECT e.* FROM e JOIN h1 ON h1.node = e.dst), i AS (SELECT a.* FROM a WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)), x AS (SELECT (SELECT count(*) FROM n) > 250 OR (SELECT count(*) FROM i) > 500 AS truncated)
        SELECT src, dst, i.weight, p_name AS title, truncated FROM (SELECT * FROM i ORDER BY weight DESC, src, dst LIMIT 500) i JOIN part ON p_partkey = dst, x""",
)
def pattern_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies within two hops of a pattern: the 250 first nodes by hop and weight, the 500 heaviest edges among them, with titles, and whether more was there."""
    edges = supply_edges(spark, sf_dir)
    hop1 = edges.where("src = -1").select(F.col("dst").alias("node"), F.col("weight").alias("best"))
    around = edges.join(hop1.select(F.col("node").alias("dst")), "dst", "left_semi")
    hop2 = around.where("src <> -1").groupBy(F.col("src").alias("node")).agg(F.max("weight").alias("best"))
    root = spark.createDataFrame([(-1, 9.0)], "node long, best double")
    nodes = root.withColumn("depth", F.lit(0)).unionByName(hop1.withColumn("depth", F.lit(1))).unionByName(hop2.withColumn("depth", F.lit(2)))
    kept = nodes.orderBy("depth", F.desc("best"), "node").limit(250).select("node")
    inner = around.join(kept.select(F.col("node").alias("src")), "src", "left_semi").join(kept.select(F.col("node").alias("dst")), "dst", "left_semi")
    more = nodes.agg((F.count("*") > 250).alias("n")).join(inner.agg((F.count("*") > 500).alias("e"))).select((F.col("n") | F.col("e")).alias("truncated"))
    best = inner.orderBy(F.desc("weight"), "src", "dst").limit(500).join(load(spark, sf_dir, "part"), F.col("dst") == F.col("p_partkey"))
    return best.select("src", "dst", "weight", F.col("p_name").alias("title")).join(F.broadcast(more))


@query("g04_graph_stats", f"WITH e AS ({_EDGES}) SELECT count(*) AS edges, count(DISTINCT src) AS suppliers, count(DISTINCT dst) AS parts, round(avg(weight), 6) AS mean_weight FROM e")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply_edges(spark, sf_dir).agg(F.count("*").alias("edges"), F.countDistinct("src").alias("suppliers"), F.countDistinct("dst").alias("parts"), F.round(F.avg("weight"), 6).alias("mean_weight"))


_STRENGTH = "round(weight * (1 - ((dst - src) % 3) * 0.1) * CASE WHEN dst % 2 = 0 THEN 1.0 ELSE 0.9 END, 6)"


@query(
    "g06_relevance_decay",
    f"""WITH e0 AS ({_EDGES}), e AS (SELECT src, dst, CAST({_STRENGTH} AS DOUBLE) AS weight FROM e0), u AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e), s0 AS (SELECT CAST(-1 AS BIGINT) AS node, 1.0::DOUBLE AS score, NULL::BIGINT AS parent UNION ALL SELECT -2, 0.8, NULL),
        p1 AS (SELECT u.dst AS node, round(score * least(0.72 * weight, 1), 9) AS score, u.src AS parent FROM s0 JOIN u ON u.src = s0.node), h1 AS (SELECT * FROM p1 QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, parent) = 1),
        s1 AS (SELECT coalesce(h.node, s.node) AS node, CASE WHEN s.score IS NULL OR h.score > s.score THEN h.score ELSE s.score END AS score, CASE WHEN s.score IS NULL OR h.score > s.score THEN h.parent ELSE s.parent END AS parent FROM s0 s FULL JOIN h1 h ON h.node = s.node),
        p2 AS (SELECT u.dst AS node, round(score * least(0.72 * weight, 1), 9) AS score, u.src AS parent FROM s1 JOIN u ON u.src = s1.node WHERE s1.parent IS NOT NULL), h2 AS (SELECT * FROM p2 QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, parent) = 1)
        SELECT coalesce(h.node, s.node) AS node, round(CASE WHEN s.score IS NULL OR h.score > s.score THEN h.score ELSE s.score END, 6) AS score, CASE WHEN s.score IS NULL OR h.score > s.score THEN h.parent ELSE s.parent END AS parent FROM s1 s FULL JOIN h2 h ON h.node = s.node""",
)
def relevance_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops from two seeds; an edge's strength is its weight, confidence and relevance."""
    seeds = spark.createDataFrame([(-1, 1.0), (-2, 0.8)], "node long, score double")
    edges = supply_edges(spark, sf_dir).select("src", "dst", F.expr(_STRENGTH).cast("double").alias("weight"))
    return decay_expand(edges, seeds, 2).select("node", F.round("score", 6).alias("score"), "parent")


@query(
    "g09_edge_materialiser",
    """SELECT 'order_part' AS edge_type, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) UNION ALL SELECT 'customer_order', count(*) FROM orders UNION ALL SELECT 'customer_nation', count(*) FROM customer UNION ALL SELECT 'nation_region', count(*) FROM nation""",
)
def edge_materialiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relational rows as typed edges, one for each logical key."""
    t = lambda name: load(spark, sf_dir, name)
    edge = lambda df, kind, a, b: df.select(F.lit(kind).alias("edge_type"), F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst")).distinct()
    edges = edge(t("lineitem"), "order_part", "l_orderkey", "l_partkey").unionByName(edge(t("orders"), "customer_order", "o_custkey", "o_orderkey")).unionByName(edge(t("customer"), "customer_nation", "c_custkey", "c_nationkey")).unionByName(edge(t("nation"), "nation_region", "n_nationkey", "n_regionkey"))
    return edges.groupBy("edge_type").agg(F.count("*").alias("n"))


@query("g10_decision_chain", "WITH RECURSIVE c(root, id, depth) AS (SELECT o_orderkey, o_orderkey, 0 FROM orders UNION ALL SELECT c.root, c.id // 2, c.depth + 1 FROM c WHERE c.id > 1 AND c.depth < 6) SELECT root, id, depth FROM c")
def decision_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every decision's ancestors up to six levels; the parent of a decision is half its number.  ``g10_decision_chain_all`` has the descendants as well."""
    level = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("root"), F.col("o_orderkey").alias("id"), F.lit(0).alias("depth"))
    out = level
    for depth in range(1, 7):
        level = level.where("id > 1").select("root", F.expr("id div 2").alias("id"), F.lit(depth).alias("depth"))
        out = out.unionByName(level)
    return out


@query("g10_decision_chain_all")
def decision_chain_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of every order, up and down; the parent of a decision is half its number, where there is one."""
    parent = F.when(F.col("o_orderkey") > 1, F.expr("o_orderkey div 2"))
    return decision_chains(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), parent.alias("parent"), F.col("o_orderdate").alias("at")))


#: Signals made of the events: a place and two symptoms each, some undated; some name an earlier one as theirs.
_SIGNALS = """s AS (SELECT event_id AS id, CASE WHEN event_id % 97 <> 0 THEN ts END AS seen, CASE event_id % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' END AS environment, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
       l AS (SELECT id AS a, id - 1 - k AS b, CASE k % 20 WHEN 3 THEN 'child_of_incident' WHEN 7 THEN 'duplicate_of' ELSE 'related_problem' END AS kind FROM s WHERE k % 20 IN (3, 7, 9))"""


def event_signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Signals, their items, their symptoms and the links between them, of all events."""
    events = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    signals = events.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 97 != 0, F.col("ts")).alias("at"), F.when(F.col("event_id") % 3 == 0, "prod").when(F.col("event_id") % 3 == 1, "staging").alias("environment"))
    items = events.select(F.col("event_id").alias("id"), (F.col("user_id") * 10 + F.col("k") % 10).alias("item"))
    symptoms = events.select(F.col("event_id").alias("id"), F.explode(F.array("event_type", F.concat(F.lit("k"), (F.col("k") % 7).cast("string")))).alias("signature"))
    kind = F.when(F.col("k") % 20 == 3, "child_of_incident").when(F.col("k") % 20 == 7, "duplicate_of").otherwise("related_problem")
    links = events.where((F.col("k") % 20).isin(3, 7, 9)).select(F.col("event_id").alias("a"), (F.col("event_id") - 1 - F.col("k")).alias("b"), kind.alias("kind"))
    return signals, items, symptoms, links


@query(
    "g12_situation_components",
    f"""WITH RECURSIVE {_SIGNALS}, i AS (SELECT id, user_id * 10 + k % 10 AS item FROM s), plain AS (SELECT * FROM i WHERE item NOT IN (SELECT item FROM i WHERE item IS NOT NULL GROUP BY item HAVING count(DISTINCT id) > 8)),
       y AS (SELECT id, event_type AS signature FROM s UNION ALL SELECT id, 'k' || CAST(k % 7 AS VARCHAR) FROM s),
       sure AS (SELECT a, b FROM l WHERE kind IN ('child_of_incident', 'duplicate_of') AND b IN (SELECT id FROM s) AND a IN (SELECT id FROM s)),
       likely AS (SELECT DISTINCT a.id AS a, b.id AS b FROM plain a JOIN plain b ON a.item = b.item AND a.id < b.id JOIN s x ON x.id = a.id JOIN s z ON z.id = b.id JOIN y p ON p.id = a.id JOIN y q ON q.id = b.id AND q.signature = p.signature
           WHERE x.seen <= z.seen + INTERVAL 24 HOUR AND z.seen <= x.seen + INTERVAL 24 HOUR AND (x.environment IS NULL OR z.environment IS NULL OR x.environment = z.environment)),
       u AS (SELECT a, b FROM sure UNION SELECT b, a FROM sure UNION SELECT a, b FROM likely UNION SELECT b, a FROM likely),
       r(node, comp) AS (SELECT a, a FROM u UNION SELECT u.b, r.comp FROM r JOIN u ON u.a = r.node), c AS (SELECT node AS id, min(comp) AS situation FROM r GROUP BY node),
       m AS (SELECT situation, id, seen, id IN (SELECT a FROM sure UNION SELECT b FROM sure) AS sure FROM c JOIN s USING (id)),
       g AS (SELECT situation, count(*) AS members, bool_or(sure) AS any_sure, min(seen) AS onset, max(seen) AS last_signal, arg_min(id, (seen IS NULL, seen, id)) AS primary_id,
           sha256(CAST(count(*) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 15) AS HUGEINT)) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 16, 15) AS HUGEINT)) AS VARCHAR)) AS fingerprint FROM m GROUP BY situation)
       SELECT situation, id, CASE WHEN id = primary_id THEN 'primary_incident' ELSE 'related_incident' END AS role, CASE WHEN sure THEN 'authoritative' ELSE 'inferred' END AS method, CASE WHEN sure THEN 'confirmed' ELSE 'inferred' END AS status,
           CAST(CASE WHEN sure THEN 0.95 ELSE 0.5 END AS DOUBLE) AS confidence, CASE WHEN members >= 5 THEN 'incident_storm' WHEN any_sure THEN 'degradation' ELSE 'unknown' END AS kind, CASE WHEN any_sure THEN 'active' ELSE 'emerging' END AS state,
           CAST(CASE WHEN any_sure THEN 0.9 ELSE 0.5 END AS DOUBLE) AS situation_confidence, onset, last_signal, members, fingerprint FROM m JOIN g USING (situation)""",
)
def situation_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of every situation: links that people set, then signals that agree in item, 24 hours, symptom and environment."""
    return correlate(*event_signals(spark, sf_dir)).drop("at")


@query(
    "g13_title_overlap_components",
    """SELECT p_name AS title, count(DISTINCT p_partkey) AS members, min(p_partkey) AS canonical FROM part WHERE EXISTS (SELECT 1 FROM part q WHERE q.p_name = part.p_name AND q.p_brand = part.p_brand AND q.p_partkey <> part.p_partkey) GROUP BY 1""",
)
def title_overlap_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same title and a shared item (brand); shared items are counted in a window, not joined."""
    shared = F.count("*").over(Window.partitionBy("p_name", "p_brand"))
    return load(spark, sf_dir, "part").withColumn("n", shared).where("n > 1").groupBy(F.col("p_name").alias("title")).agg(F.countDistinct("p_partkey").alias("members"), F.min("p_partkey").alias("canonical"))


@query("g19_signature_arm", "SELECT l_partkey AS playbook, min(o_orderkey) AS via FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def signature_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    approved = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    urgent = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").join(approved, "o_custkey", "left_semi")
    return load(spark, sf_dir, "lineitem").join(urgent, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_partkey").alias("playbook")).agg(F.min("o_orderkey").alias("via"))


@query(
    "g24_identity_correlation",
    """WITH d AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS degree FROM lineitem GROUP BY 1), s AS (SELECT DISTINCT l_orderkey, l_partkey, degree, l_partkey % 2 = 1 AS person, CAST(o_orderdate AS DATE) AS day, o_custkey FROM lineitem JOIN d USING (l_partkey) JOIN orders ON o_orderkey = l_orderkey WHERE degree < 200),
            p AS (SELECT a.l_orderkey AS a, b.l_orderkey AS b, count(*) AS shared, bool_or(NOT a.person AND a.degree <= 5) AS rare, bool_and(a.person) AS only_persons FROM s a JOIN s b ON a.l_partkey = b.l_partkey AND a.l_orderkey < b.l_orderkey AND abs(a.day - b.day) <= 7 GROUP BY 1, 2),
            i AS (SELECT a, b, CASE WHEN only_persons THEN CASE WHEN shared >= 2 THEN 0.5 END ELSE least(0.85, CASE WHEN rare THEN 0.75 ELSE 0.65 END + CASE WHEN shared >= 2 THEN 0.1 ELSE 0 END) END AS confidence FROM p),
            c AS (SELECT x.o_orderkey AS a, y.o_orderkey AS b FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey)
       SELECT a, b, max(CAST(round(confidence, 4) AS DOUBLE)) AS confidence, arg_max(tier, confidence) AS tier FROM (SELECT a, b, confidence, 'identity' AS tier FROM i WHERE confidence IS NOT NULL UNION ALL SELECT a, b, 1.0, 'case_link' FROM c) GROUP BY 1, 2""",
)
def identity_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that one record links, and cases within seven days that share identities.

    A link of records is certain.  Hubs are removed before the join; a thing
    counts more than a person, a rare one more than a common one, and persons
    alone count only from two on.
    """
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    degrees = lines.groupBy("l_partkey").agg(F.count("*").alias("degree")).where("degree < 200")
    known = lines.join(degrees, "l_partkey").join(orders.drop("o_custkey"), "l_orderkey").withColumn("person", F.col("l_partkey") % 2 == 1)
    a, b = known.alias("a"), known.alias("b")
    near = (F.col("a.l_partkey") == F.col("b.l_partkey")) & (F.col("a.l_orderkey") < F.col("b.l_orderkey")) & (F.abs(F.datediff("a.day", "b.day")) <= 7)
    pairs = a.join(b, near).groupBy(F.col("a.l_orderkey").alias("a"), F.col("b.l_orderkey").alias("b")).agg(F.count("*").alias("shared"), F.bool_or(~F.col("a.person") & (F.col("a.degree") <= 5)).alias("rare"), F.bool_and("a.person").alias("only_persons"))
    signal = F.when(F.col("only_persons"), F.when(F.col("shared") >= 2, 0.5)).otherwise(F.least(F.lit(0.85), F.when(F.col("rare"), 0.75).otherwise(0.65) + F.when(F.col("shared") >= 2, 0.1).otherwise(0.0)))
    identity = pairs.select("a", "b", F.round(signal, 4).alias("confidence"), F.lit("identity").alias("tier")).where("confidence IS NOT NULL")
    x, y = orders.alias("x"), orders.alias("y")
    linked = x.join(y, (F.col("x.o_custkey") == F.col("y.o_custkey")) & (F.col("x.l_orderkey") < F.col("y.l_orderkey"))).select(F.col("x.l_orderkey").alias("a"), F.col("y.l_orderkey").alias("b"), F.lit(1.0).alias("confidence"), F.lit("case_link").alias("tier"))
    return identity.unionByName(linked).groupBy("a", "b").agg(F.max("confidence").alias("confidence"), F.max_by("tier", "confidence").alias("tier"))


@query(
    "g25_inference_refresh",
    """WITH n AS (SELECT l_suppkey AS id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) >= 180), o AS (SELECT l_suppkey AS id, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1 HAVING count(*) >= 180)
       SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'expire' WHEN n.n <> o.n THEN 'refresh' ELSE 'keep' END AS action FROM n FULL JOIN o ON n.id = o.id""",
)
def inference_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a recomputed inference does to the stored one."""
    counted = lambda flag, name: load(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias(name)).where(F.col(name) >= 180)
    both = counted("R", "new").join(counted("A", "old"), "id", "full")
    return both.select("id", F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "expire").when(F.col("new") != F.col("old"), "refresh").otherwise("keep").alias("action"))


@query(
    "g26_change_candidates",
    """WITH hops AS (SELECT DISTINCT user_id, user_id AS near, 0 AS hop FROM events UNION ALL SELECT DISTINCT user_id, user_id + 1, 1 FROM events WHERE user_id % 3 = 0 UNION ALL SELECT DISTINCT user_id + 1, user_id, 1 FROM events WHERE user_id % 3 = 0)
       SELECT c.event_id AS change_id, i.event_id AS incident_id, min(hop) AS hop, CASE WHEN i.ts >= c.ts THEN 'candidate' ELSE 'planned_after' END AS status FROM events c JOIN hops h ON h.user_id = c.user_id JOIN events i ON i.user_id = h.near AND c.event_type = 'signup' AND i.event_type = 'error' AND i.ts <= c.ts + INTERVAL 7 DAY AND i.ts >= c.ts - INTERVAL 2 DAY GROUP BY 1, 2, 4""",
)
def change_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes up to seven days before and two after an incident, on its item or one that it depends on directly (every third item on the next one)."""
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    c = events.where("event_type = 'signup'").withColumn("reach", F.array(F.struct(F.col("user_id").alias("near"), F.lit(0).alias("hop")), F.when(F.col("user_id") % 3 == 0, F.struct((F.col("user_id") + 1).alias("near"), F.lit(1).alias("hop"))), F.when(F.col("user_id") % 3 == 1, F.struct((F.col("user_id") - 1).alias("near"), F.lit(1).alias("hop")))))
    items = events.select(F.col("user_id").alias("near")).distinct()
    c = c.select("event_id", "ts", F.explode("reach").alias("r")).where("r IS NOT NULL").select("event_id", "ts", "r.near", "r.hop").alias("c")
    i = events.where("event_type = 'error'").alias("i")
    window = (F.col("i.ts") <= F.col("c.ts") + F.expr("INTERVAL 7 DAY")) & (F.col("i.ts") >= F.col("c.ts") - F.expr("INTERVAL 2 DAY"))
    return c.join(items, "near", "left_semi").alias("c").join(i, (F.col("c.near") == F.col("i.user_id")) & window).select(F.col("c.event_id").alias("change_id"), F.col("i.event_id").alias("incident_id"), "hop", F.when(F.col("i.ts") >= F.col("c.ts"), "candidate").otherwise("planned_after").alias("status"))


@query(
    "g28_identity_cascade",
    """SELECT c_custkey, coalesce(strong, alias_match, candidate) AS identity, CASE WHEN strong IS NOT NULL THEN 'strong' WHEN alias_match IS NOT NULL THEN 'alias' WHEN candidate IS NOT NULL THEN 'candidate' ELSE 'new' END AS tier
       FROM (SELECT c_custkey, (SELECT min(s_suppkey) FROM supplier WHERE s_suppkey = c_custkey AND s_nationkey = c_nationkey) AS strong, (SELECT min(s_suppkey) FROM supplier WHERE s_suppkey = c_custkey) AS alias_match,
             (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = c_nationkey) AS candidate FROM customer)""",
)
def identity_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, suppliers = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), load(spark, sf_dir, "supplier")
    exact = suppliers.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_suppkey").alias("alias_match"), "s_nationkey")
    loose = suppliers.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("candidate"))
    found = customers.join(exact, "c_custkey", "left").join(loose, "c_nationkey", "left").withColumn("strong", F.when(F.col("s_nationkey") == F.col("c_nationkey"), F.col("alias_match")))
    tier = F.when(F.col("strong").isNotNull(), "strong").when(F.col("alias_match").isNotNull(), "alias").when(F.col("candidate").isNotNull(), "candidate").otherwise("new")
    return found.select("c_custkey", F.coalesce("strong", "alias_match", "candidate").alias("identity"), tier.alias("tier"))


@query("g29_identity_promotion", "SELECT l_partkey, count(DISTINCT l_orderkey) AS evidence FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 2 ORDER BY evidence DESC, l_partkey LIMIT 5")
def identity_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("evidence")).where("evidence >= 2").orderBy(F.desc("evidence"), "l_partkey").limit(5)


@query("g30_identity_merge", "WITH m AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS kept FROM part) SELECT DISTINCT l_orderkey, kept AS l_partkey FROM lineitem JOIN m ON p_partkey = l_partkey")
def identity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys are rewritten to the survivor, then made distinct again."""
    kept = load(spark, sf_dir, "part").select("p_partkey", F.min("p_partkey").over(Window.partitionBy("p_name")).alias("kept"))
    return load(spark, sf_dir, "lineitem").join(kept, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("kept").alias("l_partkey")).distinct()


@query("g33_recurrence_link", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS recurs FROM events WHERE event_type = 'error'")
def recurrence_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = F.lag("event_id").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return load(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", prior.alias("recurs"))


@query(
    "g34_document_duplicates",
    """WITH h AS (SELECT doc_id, sha256(text) AS bytes, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS norm FROM documents), b AS (SELECT *, count(*) OVER (PARTITION BY bytes) AS nb FROM h),
            t AS (SELECT *, CASE WHEN nb = 1 THEN count(*) FILTER (WHERE nb = 1) OVER (PARTITION BY norm) END AS nt FROM b)
       SELECT CASE WHEN nb > 1 THEN 'bytes' ELSE 'text' END AS kind, CASE WHEN nb > 1 THEN bytes ELSE norm END AS key, count(*) AS members, min(doc_id) AS primary_id FROM t WHERE nb > 1 OR nt > 1 GROUP BY 1, 2""",
)
def document_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal bytes, then groups of equal normalised text among the rest."""
    hashed = load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("bytes"), F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256).alias("norm"))
    by_bytes = hashed.groupBy("bytes", "norm").agg(F.count("*").alias("nb"), F.min("doc_id").alias("first"))
    exact = by_bytes.where("nb > 1").select(F.lit("bytes").alias("kind"), F.col("bytes").alias("key"), F.col("nb").alias("members"), F.col("first").alias("primary_id"))
    rest = by_bytes.where("nb = 1").groupBy("norm").agg(F.count("*").alias("members"), F.min("first").alias("primary_id")).where("members > 1")
    return exact.unionByName(rest.select(F.lit("text").alias("kind"), F.col("norm").alias("key"), "members", "primary_id"))


@query("g38_retention", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01' - CASE o_orderpriority WHEN '1-URGENT' THEN INTERVAL 2000 DAY WHEN '2-HIGH' THEN INTERVAL 1000 DAY ELSE INTERVAL 365 DAY END")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows within the window of their memory class."""
    days = F.when(F.col("o_orderpriority") == "1-URGENT", 2000).when(F.col("o_orderpriority") == "2-HIGH", 1000).otherwise(365)
    return load(spark, sf_dir, "orders").where(F.col("o_orderdate").cast("date") >= F.date_sub(F.lit("2001-08-01").cast("date"), days)).select("o_orderkey")


@query("g40_domain_audit", "SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 25 IS DISTINCT FROM c_nationkey AND o_totalprice > 400000")
def domain_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = load(spark, sf_dir, "orders").where("o_totalprice > 400000").join(load(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return joined.where(~(F.col("o_orderkey") % 25).eqNullSafe(F.col("c_nationkey"))).select("o_orderkey", "c_nationkey")


@query(
    "g49_verdict_ladder",
    """WITH c AS (SELECT l_orderkey AS run, count(*) FILTER (WHERE l_returnflag = 'R') AS fails, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O') AS incident_fails, count(*) FILTER (WHERE l_returnflag = 'N') AS passes, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS open, count(*) AS n FROM lineitem GROUP BY 1)
       SELECT run, CASE WHEN fails > 0 AND passes > 0 THEN 'partial_success' WHEN fails > 0 AND incident_fails > 0 THEN 'rollback_required' WHEN fails > 0 THEN 'failed' WHEN passes > 0 AND open = 0 THEN 'success' WHEN passes > 0 THEN 'monitor_required' ELSE 'inconclusive' END AS verdict FROM c""",
)
def verdict_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fail: partial with a pass, rollback if an incident criterion failed, else failed; then success, monitor, inconclusive."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    c = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.count_if(flag == "R").alias("fails"), F.count_if((flag == "R") & (status == "O")).alias("incident_fails"), F.count_if(flag == "N").alias("passes"), F.count_if((flag == "A") & (status == "F")).alias("open"))
    fails, passes = F.col("fails") > 0, F.col("passes") > 0
    return c.select("run", F.when(fails & passes, "partial_success").when(fails & (F.col("incident_fails") > 0), "rollback_required").when(fails, "failed").when(passes & (F.col("open") == 0), "success").when(passes, "monitor_required").otherwise("inconclusive").alias("verdict"))


#: Literal policies: (id, segment, nation, priority, verdict rank, name); None is a wildcard.
POLICIES = ((1, None, None, 1, 0, "default"), (2, "BUILDING", None, 5, 1, "building"), (3, None, 3, 5, 2, "nation-three"), (4, "BUILDING", 3, 1, 3, "building-three"), (5, "MACHINERY", None, 9, 1, "machinery"), (6, "MACHINERY", None, 2, 3, "machinery-strict"))
_POLICY_ROWS = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in p) + ")" for p in POLICIES)


_FROM_TO = {1: (None, None), 2: (None, "1996-01-01"), 3: ("1994-01-01", None), 4: ("1995-01-01", "1997-06-01"), 5: (None, None), 6: ("1993-06-01", "1998-01-01")}
_DATED = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in p) + ", " + ", ".join("NULL::DATE" if d is None else f"DATE '{d}'" for d in _FROM_TO[p[0]]) + ")" for p in POLICIES)


@query(
    "g51_policy_selection",
    f"""SELECT o_orderkey, id FROM (SELECT o_orderkey, p.id, row_number() OVER (PARTITION BY o_orderkey ORDER BY (p.segment IS NOT NULL)::INT + (p.nation IS NOT NULL)::INT DESC, p.priority DESC, p.strict DESC, p.name) AS rn
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN (VALUES {_DATED}) p(id, segment, nation, priority, strict, name, since, until) ON (p.segment IS NULL OR p.segment = c_mktsegment) AND (p.nation IS NULL OR p.nation = c_nationkey) AND (since IS NULL OR since <= CAST(o_orderdate AS DATE)) AND (until IS NULL OR CAST(o_orderdate AS DATE) < until)) WHERE rn = 1""",
)
def policy_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy in force for each order: null axes match all, [from, to) holds; the most specific wins, then priority, strictness, name.  The policies are a small fixed table."""
    policies = spark.createDataFrame([(*p, *_FROM_TO[p[0]]) for p in POLICIES], "id int, segment string, nation int, priority int, strict int, name string, since string, until string").withColumns({c: F.col(c).cast("date") for c in ("since", "until")})
    day = F.col("o_orderdate").cast("date")
    fits = (F.col("segment").isNull() | (F.col("segment") == F.col("c_mktsegment"))) & (F.col("nation").isNull() | (F.col("nation") == F.col("c_nationkey"))) & (F.col("since").isNull() | (F.col("since") <= day)) & (F.col("until").isNull() | (day < F.col("until")))
    cases = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    specific = F.col("segment").isNotNull().cast("int") + F.col("nation").isNotNull().cast("int")
    # The best of a case by one aggregate: no window over the cases.
    best = cases.join(F.broadcast(policies), fits).groupBy("o_orderkey").agg(F.min_by("id", F.struct(-specific, -F.col("priority"), -F.col("strict"), "name")).alias("id"))
    return best


@query(
    "g52_support_level",
    """WITH c AS (SELECT l_partkey AS item, count(*) FILTER (WHERE l_returnflag = 'N') AS ok, count(*) FILTER (WHERE l_returnflag = 'R') AS bad FROM lineitem GROUP BY 1)
       SELECT item, CASE WHEN ok + bad = 0 THEN 'unproven' WHEN bad / (ok + bad) >= 0.34 THEN 'contested' WHEN ok >= 3 THEN 'proven' WHEN ok > 0 THEN 'emerging' ELSE 'unproven' END AS level FROM c""",
)
def support_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.count_if(F.col("l_returnflag") == "N").alias("ok"), F.count_if(F.col("l_returnflag") == "R").alias("bad"))
    decided = F.col("ok") + F.col("bad")
    return c.select("item", F.when(decided == 0, "unproven").when(F.try_divide("bad", decided) >= 0.34, "contested").when(F.col("ok") >= 3, "proven").when(F.col("ok") > 0, "emerging").otherwise("unproven").alias("level"))


@query("g54_class_chain", "WITH RECURSIVE c(node, top, chain, depth) AS (SELECT p_partkey, p_partkey, CAST(p_partkey AS VARCHAR), 1 FROM part UNION ALL SELECT node, top // 5, (top // 5) || ' > ' || chain, depth + 1 FROM c WHERE top >= 5) SELECT node, arg_max(chain, depth) AS chain, max(depth) AS depth FROM c GROUP BY 1")
def class_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way from the root to every class; the parent of a class is a fifth of its number.  Each round doubles the way that is known."""
    parents = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") >= 5, F.expr("p_partkey div 5")).alias("parent"))
    above = parents.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct().join(parents.select("node"), "node", "left_anti").select("node", F.when(F.col("node") >= 5, F.expr("node div 5")).alias("parent"))
    return ancestor_chains(parents.unionByName(above)).join(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")), "node", "left_semi").select("node", F.array_join("chain", " > ").alias("chain"), F.size("chain").alias("depth"))


@query("g55_worst_state", "SELECT o_custkey, ['pass', 'warn', 'stale', 'fail'][max(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)] AS state FROM orders GROUP BY 1")
def worst_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst of all dimensions."""
    rank = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3) + (F.col("o_orderpriority") == "1-URGENT").cast("int")
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.element_at(F.array(*map(F.lit, ("pass", "warn", "stale", "fail"))), F.max(rank)).alias("state"))


@query("g56_gap_dedup", "SELECT gap_key, min(prio) AS prio, count(*) AS seen FROM (SELECT 'missing:' || o_orderpriority AS gap_key, 1 AS prio FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'late:' || o_orderpriority, 2 FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01') GROUP BY 1")
def gap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    gaps = orders.where("o_orderstatus = 'P'").select(F.concat(F.lit("missing:"), "o_orderpriority").alias("gap_key"), F.lit(1).alias("prio")).unionByName(orders.where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))).select(F.concat(F.lit("late:"), "o_orderpriority").alias("gap_key"), F.lit(2).alias("prio")))
    return gaps.groupBy("gap_key").agg(F.min("prio").alias("prio"), F.count("*").alias("seen"))


@query("g59_staleness_propagation", "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') AND l_returnflag = 'R'")
def staleness_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(changed, "l_orderkey", "left_semi").select("l_suppkey").distinct()


@query("g62_claim_dedup", "SELECT lower(trim(event_type)) || ':' || json_extract_string(props, '$.k') AS claim, min(event_id) AS first_id, count(*) AS n FROM events GROUP BY 1")
def claim_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy(F.concat_ws(":", F.lower(F.trim("event_type")), F.get_json_object("props", "$.k")).alias("claim")).agg(F.min("event_id").alias("first_id"), F.count("*").alias("n"))


@query("g63_idempotency", "SELECT event_id, min(event_id) OVER (PARTITION BY sha256(user_id || ':' || event_type || ':' || props)) AS original FROM events")
def idempotency(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.sha2(F.concat_ws(":", "user_id", "event_type", "props"), 256)
    return load(spark, sf_dir, "events").select("event_id", F.min("event_id").over(Window.partitionBy(key)).alias("original"))


@query("g48_post_action_check", "SELECT a.event_id AS action_id, count(DISTINCT i.event_id) AS incidents_after FROM events a LEFT JOIN events i ON i.user_id = a.user_id AND i.event_type = 'error' AND i.ts > a.ts AND i.ts <= a.ts + INTERVAL 3 DAY WHERE a.event_type = 'purchase' GROUP BY 1")
def post_action_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    a, i = events.where("event_type = 'purchase'").alias("a"), events.where("event_type = 'error'").alias("i")
    return a.join(i, (F.col("a.user_id") == F.col("i.user_id")) & (F.col("i.ts") > F.col("a.ts")) & (F.col("i.ts") <= F.col("a.ts") + F.expr("INTERVAL 3 DAY")), "left").groupBy(F.col("a.event_id").alias("action_id")).agg(F.countDistinct("i.event_id").alias("incidents_after"))


@query(
    "g50_remediation_advice",
    """WITH e AS (SELECT l_partkey AS item, count(*) FILTER (WHERE l_returnflag = 'N') AS ok, count(*) FILTER (WHERE l_returnflag IN ('N', 'R')) AS n FROM lineitem GROUP BY 1)
       SELECT item, ok, n, CASE WHEN n >= 20 AND ok / n >= 0.6 THEN 1 WHEN ok / n >= 0.5 THEN 2 WHEN ok > 0 THEN 3 ELSE 4 END AS level FROM e WHERE n > 0 ORDER BY level, ok / n DESC, n DESC, item LIMIT 50""",
)
def remediation_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.count_if(F.col("l_returnflag") == "N").alias("ok"), F.count_if(F.col("l_returnflag").isin("N", "R")).alias("n")).where("n > 0")
    rate = F.col("ok") / F.col("n")
    level = F.when((F.col("n") >= 20) & (rate >= 0.6), 1).when(rate >= 0.5, 2).when(F.col("ok") > 0, 3).otherwise(4)
    return e.withColumn("level", level).orderBy("level", F.desc(rate), F.desc("n"), "item").limit(50)


_CHAINS = """e AS (SELECT event_id, user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 24 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 c AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS chain FROM e), situations AS (SELECT user_id, min(event_id) AS situation, min(ts) AS began, max(ts) AS ended, count(*) AS members FROM c GROUP BY user_id, chain)"""


def situations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, situation, began, ended, members``: errors of an item without a gap of more than 24 hours."""
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    errors = load(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", "ts")
    fresh = F.coalesce(F.col("ts") > F.lag("ts").over(by_time) + F.expr("INTERVAL 24 HOUR"), F.lit(True)).cast("int")
    chains = errors.withColumn("fresh", fresh).withColumn("chain", F.sum("fresh").over(by_time))
    return chains.groupBy("user_id", "chain").agg(F.min("event_id").alias("situation"), F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("members")).drop("chain")


@query(
    "g27_recurrence",
    f"""WITH {_CHAINS} SELECT user_id, situation, lag(situation) OVER w AS prior, CASE WHEN lag(ended) OVER w IS NULL THEN 'new' WHEN began <= lag(ended) OVER w + INTERVAL 48 HOUR THEN 'merge' WHEN began <= lag(ended) OVER w + INTERVAL 7 DAY THEN 'recurrence' ELSE 'new' END AS relation FROM situations WINDOW w AS (PARTITION BY user_id ORDER BY began, situation)""",
)
def recurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each situation and the one before it on its item: close ones merge, those within a week recur."""
    w = Window.partitionBy("user_id").orderBy("began", "situation")
    ended = F.lag("ended").over(w)
    relation = F.when(ended.isNull(), "new").when(F.col("began") <= ended + F.expr("INTERVAL 48 HOUR"), "merge").when(F.col("began") <= ended + F.expr("INTERVAL 7 DAY"), "recurrence").otherwise("new")
    return situations(spark, sf_dir).select("user_id", "situation", F.lag("situation").over(w).alias("prior"), relation.alias("relation"))


@query(
    "g48_observed_outcomes",
    """WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), g AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY 1)
       SELECT a.event_id AS action_id, CASE WHEN g.seen < a.ts + INTERVAL 3 DAY THEN 'not_observable' WHEN count(DISTINCT i.event_id) = 0 THEN 'pass' WHEN count(DISTINCT i.event_id) <= 2 THEN 'inconclusive' ELSE 'fail' END AS verdict
       FROM a JOIN g ON g.user_id = a.user_id LEFT JOIN events i ON i.user_id = a.user_id AND i.event_type = 'error' AND i.ts > a.ts AND i.ts <= a.ts + INTERVAL 3 DAY GROUP BY a.event_id, a.ts, g.seen""",
)
def observed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether incidents followed an action within three days; where nothing was seen that long, nothing can be said."""
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    seen = events.groupBy("user_id").agg(F.max("ts").alias("seen"))
    a, i = events.where("event_type = 'purchase'").join(seen, "user_id").alias("a"), events.where("event_type = 'error'").alias("i")
    after = (F.col("a.user_id") == F.col("i.user_id")) & (F.col("i.ts") > F.col("a.ts")) & (F.col("i.ts") <= F.col("a.ts") + F.expr("INTERVAL 3 DAY"))
    n = a.join(i, after, "left").groupBy(F.col("a.event_id").alias("action_id"), F.col("a.ts").alias("ts"), "seen").agg(F.countDistinct("i.event_id").alias("n"))
    verdict = F.when(F.col("seen") < F.col("ts") + F.expr("INTERVAL 3 DAY"), "not_observable").when(F.col("n") == 0, "pass").when(F.col("n") <= 2, "inconclusive").otherwise("fail")
    return n.select("action_id", verdict.alias("verdict"))


@query(
    "g62_case_timeline",
    "SELECT * FROM (SELECT user_id, event_id, lag(event_type) OVER w AS from_state, event_type AS to_state, row_number() OVER w AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE from_state IS DISTINCT FROM to_state",
)
def case_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of state of each case in order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", F.lag("event_type").over(w).alias("from_state"), F.col("event_type").alias("to_state"), F.row_number().over(w).alias("step"))
    return rows.where(~F.col("from_state").eqNullSafe(F.col("to_state")))


@query(
    "g63_stale_approvals",
    "WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_id, CASE WHEN NOT EXISTS (SELECT 1 FROM events d WHERE d.user_id = e.user_id AND d.event_type = 'purchase' AND d.ts > e.ts) THEN CASE WHEN ts < now - INTERVAL 24 HOUR THEN 'expired' ELSE 'pending' END ELSE 'decided' END AS state FROM events e, n WHERE event_type = 'signup'",
)
def stale_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests without a later decision expire after a day."""
    events = load(spark, sf_dir, "events")
    decided = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("decided"))
    now = F.broadcast(events.agg(F.max("ts").alias("now")))  # one row
    asked = events.where("event_type = 'signup'").join(decided, "user_id", "left").join(now)
    open_ = F.col("decided").isNull() | (F.col("decided") <= F.col("ts"))
    return asked.select("event_id", F.when(~open_, "decided").when(F.col("ts") < F.col("now") - F.expr("INTERVAL 24 HOUR"), "expired").otherwise("pending").alias("state"))


@query(
    "g59_stale_assessments",
    """WITH c AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'), p AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM c)), s AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM p) AND l_returnflag = 'R')
       SELECT l_suppkey AS assessment, count(*) AS stale_playbooks FROM s GROUP BY 1""",
)
def stale_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed evidence makes the playbooks that use it stale, and these the assessments that rest on them."""
    lines = load(spark, sf_dir, "lineitem")
    changed = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    playbooks = lines.join(changed, "l_orderkey", "left_semi").select("l_partkey").distinct()
    return lines.where("l_returnflag = 'R'").join(playbooks, "l_partkey", "left_semi").select("l_suppkey", "l_partkey").distinct().groupBy(F.col("l_suppkey").alias("assessment")).agg(F.count("*").alias("stale_playbooks"))


@query(
    "g55_group_states",
    """WITH d AS (SELECT p_brand AS grp, l_partkey, l_linenumber % 3 AS dim, max(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 3 WHEN l_returnflag = 'A' THEN 2 WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS bad FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
            i AS (SELECT grp, l_partkey, CASE WHEN count(*) < 3 THEN 'inconclusive' ELSE ['pass', 'warn', 'stale', 'fail'][max(bad) + 1] END AS state, count(*) / 3 AS share FROM d GROUP BY 1, 2)
       SELECT grp, arg_max(state, CASE state WHEN 'fail' THEN 4 WHEN 'stale' THEN 3 WHEN 'inconclusive' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) AS state, count(*) AS items, round(avg(share), 6) AS coverage FROM i GROUP BY 1""",
)
def group_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item's worst dimension, a group's worst item, and what share of dimensions was looked at; an unseen dimension is inconclusive, never a pass."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    bad = F.when((flag == "R") & (status == "F"), 3).when(flag == "A", 2).when(flag == "N", 1).otherwise(0)
    dims = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_brand").alias("grp"), "l_partkey", (F.col("l_linenumber") % 3).alias("dim")).agg(F.max(bad).alias("bad"))
    items = dims.groupBy("grp", "l_partkey").agg(F.count("*").alias("n"), F.max("bad").alias("bad")).select("grp", F.when(F.col("n") < 3, "inconclusive").otherwise(F.element_at(F.array(*map(F.lit, ("pass", "warn", "stale", "fail"))), F.col("bad") + 1)).alias("state"), (F.col("n") / 3).alias("share"))
    rank = F.when(F.col("state") == "fail", 4).when(F.col("state") == "stale", 3).when(F.col("state") == "inconclusive", 2).when(F.col("state") == "warn", 1).otherwise(0)
    return items.groupBy("grp").agg(F.max_by("state", rank).alias("state"), F.count("*").alias("items"), F.round(F.avg("share"), 6).alias("coverage"))


@query(
    "g56_information_gaps",
    """WITH p AS (SELECT p_partkey, p_name, p_size, count(l_orderkey) AS uses, count(*) FILTER (WHERE l_returnflag = 'R') AS failures, max(l_shipdate) AS latest FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2, 3), n AS (SELECT max(l_shipdate) AS now FROM lineitem),
       g AS (SELECT p_partkey, 1 AS prio, 'no_evidence:' || lower(p_name) AS gap_key FROM p WHERE uses = 0 UNION ALL SELECT p_partkey, 2, 'contradicted:' || lower(p_name) FROM p WHERE failures * 2 > uses UNION ALL SELECT p_partkey, 3, 'stale:' || lower(p_name) FROM p, n WHERE latest < now - INTERVAL 90 DAY
             UNION ALL SELECT p_partkey, 4, 'no_version:' || lower(p_name) FROM p WHERE p_size % 7 = 0 UNION ALL SELECT p_partkey, 5, 'thin:' || lower(p_name) FROM p WHERE uses BETWEEN 1 AND 10)
       SELECT gap_key, min(p_partkey) AS first_item, count(*) AS seen, row_number() OVER (PARTITION BY split_part(gap_key, ':', 1) ORDER BY count(*) DESC, gap_key) AS place FROM g GROUP BY gap_key""",
)
def information_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five kinds of gaps, each key once, in order within its kind."""
    lines = load(spark, sf_dir, "lineitem")
    uses = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("uses"), F.count_if(F.col("l_returnflag") == "R").alias("failures"), F.max("l_shipdate").alias("latest"))
    now = F.broadcast(lines.agg(F.max("l_shipdate").alias("now")))  # one row
    p = load(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"), "p_size").join(uses, "p_partkey", "left").fillna(0, ["uses", "failures"]).join(now)
    kinds = (("no_evidence", F.col("uses") == 0), ("contradicted", F.col("failures") * 2 > F.col("uses")), ("stale", F.col("latest") < F.col("now") - F.expr("INTERVAL 90 DAY")), ("no_version", F.col("p_size") % 7 == 0), ("thin", F.col("uses").between(1, 10)))
    found = p.select("p_partkey", "name", F.explode(F.filter(F.array(*(F.when(hit, F.lit(kind)) for kind, hit in kinds)), lambda k: k.isNotNull())).alias("kind"))
    keyed = found.groupBy("kind", F.concat_ws(":", "kind", "name").alias("gap_key")).agg(F.min("p_partkey").alias("first_item"), F.count("*").alias("seen"))
    return keyed.select("gap_key", "first_item", "seen", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("seen"), "gap_key")).alias("place"))
