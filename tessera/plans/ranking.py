"""Vectors, rank fusion, hybrid ranking, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import count_terms, count_tokens
from tessera.functions.vector import cosine_distance
from tessera.operators.graph import saved
from tessera.operators.merging import LEAST_COSINE, PATTERN_DISTANCE, lead_clusters, retire_duplicates, shared_evidence
from tessera.operators.ranking import fused_score, isotonic, margin_and_abstain, mmr, reciprocal_rank_fusion
from tessera.operators.vectors import build_index, near_pairs, search
from tessera.plans.registry import load, query

#: The query vector is that of this row; the lexical query is these words.
QUERY_VEC, QUERY_TERMS = 0, ("the", "tion", "that", "with")

_COS = "1 - list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({1} AS DOUBLE[]), CAST({1} AS DOUBLE[]))))"


def distances(vectors: DataFrame, seed: int = QUERY_VEC) -> DataFrame:
    """``vec_id, label, embedding, distance`` to the seed's vector, which is one broadcast row."""
    probe = vectors.where(F.col("vec_id") == seed).select(F.col("embedding").alias("probe"))
    return vectors.join(F.broadcast(probe)).select("vec_id", "label", "embedding", cosine_distance(F.col("embedding"), F.col("probe")).alias("distance"))


_DIST = f"SELECT e.vec_id, e.label, {_COS.format('e.embedding', 'q.embedding')} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {QUERY_VEC}) q"


@query("f01_t01_vector_top_k", f"SELECT vec_id, round(distance, 6) AS distance FROM ({_DIST}) ORDER BY round(distance, 9), vec_id LIMIT 20")
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances(load(spark, sf_dir, "embeddings")).orderBy(F.round("distance", 9), "vec_id").limit(20).select("vec_id", F.round("distance", 6).alias("distance"))


@query("t02_oversample", "SELECT o_orderkey, least(greatest(80, 3 * (o_custkey % 120)), 240) AS oversample FROM orders")
def oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates a request for k rows takes."""
    return load(spark, sf_dir, "orders").select("o_orderkey", F.least(F.greatest(F.lit(80), 3 * (F.col("o_custkey") % 120)), F.lit(240)).alias("oversample"))


@query("t03_mmr")
def diverse_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten diverse rows out of the 80 nearest."""
    near = distances(load(spark, sf_dir, "embeddings")).orderBy(F.round("distance", 9), "vec_id").limit(80)
    return mmr(near.select(F.lit(0).cast("long").alias("query"), F.col("vec_id").alias("id"), "distance", "embedding"), 10)


@query("t04_best_chunk_per_parent", f"SELECT label, vec_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(distance, 9), vec_id) AS rn FROM ({_DIST})) WHERE rn = 1")
def best_chunk_per_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = distances(load(spark, sf_dir, "embeddings")).groupBy("label").agg(F.min(F.struct(F.round("distance", 9).alias("d"), "vec_id", "distance")).alias("b"))
    return best.select("label", "b.vec_id", F.round("b.distance", 6).alias("distance"))


@query(
    "t05_merge_chunk_and_parent",
    f"""WITH d AS (SELECT * FROM ({_DIST})), c AS (SELECT label, min(round(distance, 6)) AS distance FROM (SELECT * FROM d WHERE vec_id % 2 = 0 ORDER BY round(distance, 9), vec_id LIMIT 20) GROUP BY 1), p AS (SELECT label, min(round(distance, 6)) AS distance FROM d WHERE vec_id % 2 = 1 GROUP BY 1)
        SELECT label, distance, 'chunk' AS origin FROM c UNION ALL SELECT label, distance, 'parent' FROM p WHERE label NOT IN (SELECT label FROM c)""",
)
def merge_chunk_and_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = distances(load(spark, sf_dir, "embeddings"))
    best = lambda x: x.groupBy("label").agg(F.min(F.round("distance", 6)).alias("distance"))
    chunks = best(d.where("vec_id % 2 = 0").orderBy(F.round("distance", 9), "vec_id").limit(20))
    parents = best(d.where("vec_id % 2 = 1")).join(chunks, "label", "left_anti")
    return chunks.withColumn("origin", F.lit("chunk")).unionByName(parents.withColumn("origin", F.lit("parent")))


@query("f44_quality_and_freshness", "SELECT user_id, round(0.6 * avg(least(value / 100, 1.0)) + 0.4 * least(count(*) / 5.0, 1.0), 6) AS quality, round(greatest(0.0, 1 - date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-15') / 180.0), 6) AS freshness FROM events GROUP BY 1")
def quality_and_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.datediff(F.lit("2024-02-15").cast("date"), F.max("ts").cast("date"))
    quality = 0.6 * F.avg(F.least(F.col("value") / 100, F.lit(1.0))) + 0.4 * F.least(F.count("*") / 5.0, F.lit(1.0))
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.round(quality, 6).alias("quality"), F.round(F.greatest(F.lit(0.0), 1 - age / 180.0), 6).alias("freshness"))


_ARMS = """SELECT l_partkey AS id, 'price' AS arm, row_number() OVER (ORDER BY sum(l_extendedprice) DESC, l_partkey) AS rank, 1.0 AS weight FROM lineitem GROUP BY l_partkey
           UNION ALL SELECT l_partkey, 'count', row_number() OVER (ORDER BY count(*) DESC, l_partkey), 0.7 FROM lineitem GROUP BY l_partkey
           UNION ALL SELECT l_partkey, 'recent', row_number() OVER (ORDER BY max(l_shipdate) DESC, l_partkey), 0.5 FROM lineitem GROUP BY l_partkey"""


def _arm(scored: DataFrame, name: str, weight: float, most: int) -> DataFrame:
    """The best ``most`` of ``scored(id, score)`` as ranks; only they are ordered together."""
    top = scored.orderBy(F.desc("score"), "id").limit(most)
    return top.select("id", F.lit(name).alias("arm"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"), F.lit(weight).alias("weight"))


@query("f46_reciprocal_rank_fusion", f"SELECT id, round(sum(weight / (60 + rank)) / (1.0 / 61 + 0.7 / 61 + 0.5 / 61), 6) AS rrf FROM (SELECT * FROM ({_ARMS}) WHERE rank <= 60) GROUP BY id")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.sum("l_extendedprice").alias("price"), F.count("*").alias("count"), F.max("l_shipdate").alias("recent"))
    arms = _arm(parts.select("id", F.col("price").alias("score")), "price", 1.0, 60).unionByName(_arm(parts.select("id", F.col("count").alias("score")), "count", 0.7, 60)).unionByName(_arm(parts.select("id", F.col("recent").alias("score")), "recent", 0.5, 60))
    return reciprocal_rank_fusion(arms).select("id", F.round("rrf", 6).alias("rrf"))


@query(
    "s02_candidate_union",
    f"""WITH a AS (SELECT *, CASE arm WHEN 'recent' THEN 1 WHEN 'price' THEN 2 ELSE 3 END AS prio FROM ({_ARMS}) WHERE rank <= 30), f AS (SELECT id, min(prio * 1000 + rank) AS k FROM a GROUP BY id)
        SELECT id, CAST(k // 1000 AS INT) AS prio FROM f ORDER BY k, id LIMIT 60""",
)
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms in their priority; an id keeps its first place; 60 in all."""
    parts = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.sum("l_extendedprice").alias("price"), F.count("*").alias("count"), F.max("l_shipdate").alias("recent"))
    arms = [_arm(parts.select("id", F.col(c).alias("score")), c, 1.0, 30).withColumn("prio", F.lit(p)) for p, c in ((1, "recent"), (2, "price"), (3, "count"))]
    places = arms[0].unionByName(arms[1]).unionByName(arms[2])
    return places.groupBy("id").agg(F.min(F.struct("prio", "rank")).alias("k")).orderBy("k", "id").limit(60).select("id", "k.prio")


_HIT = "len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w IN (" + ", ".join(f"'{t}'" for t in QUERY_TERMS) + ")))"
_HYBRID = f"""WITH lex AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, round(({_HIT}) / (len(regexp_extract_all(lower(text), '[a-z0-9]+')) + 10.0), 9) AS score FROM documents) WHERE score > 0 QUALIFY rank <= 200),
   vec AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(distance, 9), vec_id) AS rank FROM ({_DIST}) QUALIFY rank <= 200),
   rrf AS (SELECT id, sum(w / (60 + rank)) / (2.0 / 61) AS rrf FROM (SELECT id, rank, 1.0 AS w FROM lex UNION ALL SELECT id, rank, 1.0 FROM vec) GROUP BY id),
   q AS (SELECT doc_id AS id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
   s AS (SELECT rrf.id, 0.5 * rrf + 0.14 * coalesce(quality, 0.5) + 0.14 * least(n_chars / 5000.0, 1.0) + 0.1 - 0.05 * coalesce(toxic, 0) AS score FROM rrf JOIN documents ON doc_id = rrf.id LEFT JOIN q ON q.id = rrf.id)"""


@query("g21_hybrid_rank", f"{_HYBRID} SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 20")
def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and vector arms fused with quality, freshness, applicability and negative feedback: the 20 best."""
    docs = load(spark, sf_dir, "documents")
    counted = docs.select(F.col("doc_id").alias("id"), count_terms(F.col("text"), QUERY_TERMS).alias("hits"), count_tokens(F.col("text")).alias("words")).where("hits > 0")
    lexical = _arm(counted.select("id", F.round(F.col("hits") / (F.col("words") + 10.0), 9).alias("score")).where("score > 0"), "lexical", 1.0, 200)
    vector = _arm(distances(load(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("id"), (-F.round("distance", 9)).alias("score")), "vector", 1.0, 200)
    # At most 200 rows an arm: kept, as each further use would go through all texts and vectors again.
    fused = saved(reciprocal_rank_fusion(saved(lexical.unionByName(vector))))
    labels = load(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    # At most 200 ids an arm: they go to the tables, not the tables to them.
    best = F.broadcast(fused)
    known = best.join(docs.select(F.col("doc_id").alias("id"), "n_chars"), "id").join(labels.join(F.broadcast(fused.select("id")), "id", "left_semi"), "id", "left")
    score = fused_score({"rrf": F.col("rrf"), "quality": F.coalesce(F.col("quality").cast("double"), F.lit(0.5)), "freshness": F.least(F.col("n_chars") / 5000.0, F.lit(1.0)), "applicability": F.lit(1.0), "negative": F.coalesce(F.col("toxic"), F.lit(0))})
    top = known.select("id", score.alias("score")).orderBy(F.desc(F.round("score", 9)), "id").limit(20)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "id")).alias("rank"), F.round("score", 6).alias("score"))


@query("g21_abstaining_rank")
def abstaining_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with margin and abstention: empty when the first is not clearly first."""
    scored = saved(hybrid_rank(spark, sf_dir).select("id", "score"))
    return margin_and_abstain(scored, 10)


@query("f45_fused_score", "SELECT o_orderkey, round(0.5 * least(o_totalprice / 500000, 1.0) + 0.14 * 0.5 + 0.14 * CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END - 0.05 * CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END, 9) AS score FROM orders")
def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = fused_score({"rrf": F.least(F.col("o_totalprice") / 500000, F.lit(1.0)), "quality": F.lit(0.5), "freshness": (F.col("o_orderstatus") == "O").cast("double"), "negative": (F.col("o_orderpriority") == "5-LOW").cast("double")})
    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(score, 9).alias("score"))


@query(
    "a32_isotonic_calibration",
    """WITH p AS (SELECT round(least(value / 100, 1.0), 2) AS x, sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) AS t, count(*) AS n FROM events GROUP BY 1), s AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(t) OVER (ORDER BY x) AS st, sum(n) OVER (ORDER BY x) AS sn, t, n FROM p),
       m AS (SELECT i.x, j.i AS j, min((k.st - j.st + j.t) / (k.sn - j.sn + j.n)) AS low FROM s i JOIN s j ON j.i <= i.i JOIN s k ON k.i >= i.i GROUP BY 1, 2) SELECT x, round(max(low), 9) AS fitted FROM m GROUP BY 1""",
)
def isotonic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores rounded to 0.01, labels by parity of the user; the pool is one row for each of these at most 101 scores."""
    points = load(spark, sf_dir, "events").select(F.round(F.least(F.col("value") / 100, F.lit(1.0)), 2).alias("x"), (F.col("user_id") % 2 == 0).cast("double").alias("y"))
    return isotonic(points).select("x", F.round("fitted", 9).alias("fitted"))


#: Three accounts of what each vector stands for, nearer and farther ones: the vector and a part of itself reversed.
_ACCOUNTS = """a AS (SELECT vec_id * 3 + j AS id, vec_id, j, label AS space, list_transform(list_zip(embedding, list_reverse(embedding)), lambda z: CAST(z[1] AS DOUBLE) + (((vec_id + 3 * j) % 8) * j / 10.0) * CAST(z[2] AS DOUBLE)) AS v FROM embeddings, (SELECT unnest([0, 1, 2]) AS j)),
       ev AS (SELECT id, vec_id * 4 + j AS item FROM a UNION ALL SELECT id, vec_id * 4 + (j + 1) % 3 FROM a WHERE (vec_id + j) % 5 <> 0)"""


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, vec_id, j, space, embedding``: the accounts, three for each vector."""
    rows = load(spark, sf_dir, "embeddings").withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    share = ((F.col("vec_id") + 3 * F.col("j")) % 8) * F.col("j") / F.lit(10.0)
    return rows.select((F.col("vec_id") * 3 + F.col("j")).alias("id"), "vec_id", "j", F.col("label").alias("space"), F.zip_with("embedding", F.reverse("embedding"), lambda x, y: x.cast("double") + share * y.cast("double")).alias("embedding"))


def account_evidence(rows: DataFrame) -> DataFrame:
    """``id, item``: what each account tells of; some of one vector's share nothing."""
    second = F.when((F.col("vec_id") + F.col("j")) % 5 != 0, F.col("vec_id") * 4 + (F.col("j") + 1) % 3)
    return rows.select("id", F.explode(F.array(F.col("vec_id") * 4 + F.col("j"), second)).alias("item")).where("item IS NOT NULL")


@query(
    "t01_index_search",
    f"""SELECT query, id, distance, rank FROM (SELECT q.vec_id AS query, e.vec_id AS id, round({_COS.format('e.embedding', 'q.embedding')}, 6) + 0.0 AS distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS.format('e.embedding', 'q.embedding')}, 9), e.vec_id) AS INTEGER) AS rank FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0) WHERE rank <= 10""",
)
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for every vector whose id is divisible by 100, through the index, exactly."""
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("").alias("space"), "embedding")
    found = search(build_index(vectors), vectors.where("id % 100 = 0"), 10)
    return found.select("query", "id", F.round("distance", 6).alias("distance"), "rank")


@query(
    "g17_nearest_centroid",
    f"""WITH {_ACCOUNTS}, d AS (SELECT c.id, 'p' || CAST(m.vec_id % 10 AS VARCHAR) AS pattern, round({_COS.format('c.v', 'm.v')}, 9) + 0.0 AS distance FROM a c JOIN a m ON c.space = m.space AND m.j = 0 AND m.vec_id % 5 = 0 WHERE NOT (c.j = 0 AND c.vec_id % 5 = 0))
        SELECT id, pattern, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, pattern) AS rn FROM d WHERE distance < 0.30) WHERE rn = 1""",
)
def nearest_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern of the nearest member within 0.30 and the same domain, for every account that is in none."""
    rows, known, near, _ = pattern_pairs(spark, sf_dir, False)
    best = near.groupBy("id").agg(F.min(F.struct("distance", "cluster")).alias("b"))
    return best.select("id", F.col("b.cluster").alias("pattern"), F.round("b.distance", 6).alias("distance"))


def pattern_pairs(spark: SparkSession, sf_dir: str, inner: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Accounts that are in no pattern; members of patterns; the members near each account; near pairs of accounts."""
    every = accounts(spark, sf_dir)
    member = (F.col("j") == 0) & (F.col("vec_id") % 5 == 0)
    rows, known = every.where(~member), every.where(member).withColumn("cluster", F.concat(F.lit("p"), (F.col("vec_id") % 10).cast("string")))
    index = build_index(rows)
    near = near_pairs(index, PATTERN_DISTANCE, build_index(known)).join(known.select(F.col("id").alias("b"), "cluster"), "b").select(F.col("a").alias("id"), "cluster", "distance")
    return rows, known, near, near_pairs(index, PATTERN_DISTANCE) if inner else None


@query("g17_lead_clusters")
def pattern_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every account in the pattern that the pass over them gives it: joined (0.30), or grouped by a leader (0.27), within one domain."""
    rows, _, near, pairs = pattern_pairs(spark, sf_dir)
    return lead_clusters(rows, pairs, near)


@query(
    "j06_g15_cosine_pairs",
    f"""WITH {_ACCOUNTS} SELECT x.id AS a, y.id AS b, round(1 - ({_COS.format('x.v', 'y.v')}), 5) AS similarity FROM a x JOIN a y ON x.space = y.space AND x.id < y.id WHERE round({_COS.format('x.v', 'y.v')}, 9) <= 0.15""",
)
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of accounts of one parent with a cosine of 0.85 or more."""
    return account_pairs(spark, sf_dir).select("a", "b", F.round(1 - F.col("distance"), 5).alias("similarity"))


def account_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Distances have nine digits, so half of the last one is beyond every distance of 0.15.
    return near_pairs(build_index(accounts(spark, sf_dir)), 1 - LEAST_COSINE + 5e-10)


@query(
    "g15_similar_retired",
    f"""WITH RECURSIVE {_ACCOUNTS}, w AS (SELECT id, (SELECT count(*) FROM ev WHERE ev.id = a.id) AS n, CASE WHEN (vec_id + j) % 3 = 0 THEN 1 ELSE 0 END AS approved, ((vec_id * 7 + j * 3) % 10) / 10.0 AS confidence FROM a),
       p AS (SELECT x.space, x.id AS a, y.id AS b, round({_COS.format('x.v', 'y.v')}, 9) AS distance FROM a x JOIN a y ON x.space = y.space AND x.id < y.id WHERE round({_COS.format('x.v', 'y.v')}, 9) <= 0.15 AND EXISTS (SELECT 1 FROM ev e JOIN ev f ON e.item = f.item WHERE e.id = x.id AND f.id = y.id)),
       o AS (SELECT p.space, distance, CASE WHEN (x.n, x.approved, x.confidence) >= (y.n, y.approved, y.confidence) THEN a ELSE b END AS kept, CASE WHEN (x.n, x.approved, x.confidence) >= (y.n, y.approved, y.confidence) THEN b ELSE a END AS retired,
           row_number() OVER (PARTITION BY p.space ORDER BY distance, a, b) AS step FROM p JOIN w x ON x.id = a JOIN w y ON y.id = b),
       s(space, step, gone) AS (SELECT DISTINCT space, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM o
           UNION ALL SELECT s.space, o.step, CASE WHEN list_contains(gone, kept) OR list_contains(gone, retired) THEN gone ELSE list_append(gone, retired) END FROM s JOIN o ON o.space = s.space AND o.step = s.step + 1)
       SELECT o.retired, o.kept, round(1 - distance, 5) AS similarity FROM o JOIN s ON s.space = o.space AND s.step = o.step JOIN s t ON t.space = o.space AND t.step = o.step - 1 WHERE len(s.gone) > len(t.gone)""",
)
def similar_retired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts that tell again what a fuller one tells: cosine of 0.85, shared evidence, the most similar pairs first."""
    rows = accounts(spark, sf_dir)
    evidence = account_evidence(rows)
    count = evidence.groupBy("id").agg(F.count("*").alias("n"))
    strength = rows.join(count, "id").select("id", "n", ((F.col("vec_id") + F.col("j")) % 3 == 0).cast("int").alias("approved"), (((F.col("vec_id") * 7 + F.col("j") * 3) % 10) / 10.0).alias("confidence"))
    pairs = account_pairs(spark, sf_dir).select("a", "b", (1 - F.col("distance")).alias("similarity"))
    return retire_duplicates(shared_evidence(pairs, evidence), strength).select("retired", "kept", F.round("similarity", 5).alias("similarity"))


@query("g43_rank_agreement", "WITH r AS (SELECT o_orderpriority, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS a, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS b FROM orders) SELECT o_orderpriority, round(corr(a, b), 6) AS agreement FROM r GROUP BY 1")
def rank_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("o_orderpriority")
    ranks = load(spark, sf_dir, "orders").select("o_orderpriority", F.rank().over(by.orderBy("o_totalprice")).alias("a"), F.rank().over(by.orderBy("o_orderdate")).alias("b"))
    return ranks.groupBy("o_orderpriority").agg(F.round(F.corr("a", "b"), 6).alias("agreement"))
