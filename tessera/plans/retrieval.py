"""Ranked retrieval over the inverted index and the vector index, and the four arms of candidates that feed from them.

Case frames are the benchmark items, the stated query set; evidence is all
documents; a playbook is a vector with the text of the document of its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.graph import saved
from tessera.operators.lexical import MOST_OCCURRENCES, UNIT, build_postings, search_postings
from tessera.operators.vectors import build_index, search
from tessera.plans.ranking import _COS
from tessera.plans.registry import load, query

#: How many each arm gives, how many more it looks at, and the union of all, in the order of the arms.
ARM_CAPS = {"signature": 30, "embedding": 50, "lexical": 50, "evidence": 30}
OVERSAMPLE, UNION_CAP, EVIDENCE_HITS, EPISODES = 3, 60, 40, 80

_TERMS_SQL = """t AS (SELECT item_id AS query, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9._-]{1,}') AS x FROM benchmark),
    f AS (SELECT query, list_slice(list_transform(list_filter(list_zip(x, range(1, len(x) + 1)), lambda z: list_position(x, z[1]) = z[2]), lambda z: z[1]), 1, 24) AS terms FROM t),
    q AS (SELECT DISTINCT query, term FROM (SELECT query, unnest(regexp_extract_all(array_to_string(terms, ' '), '[a-z0-9]+')) AS term FROM f)), n AS (SELECT query, count(*) AS terms FROM q GROUP BY query)"""
_WEIGHTS_SQL = "{name} AS (SELECT id, term, list_sum(list_transform(range(1, least(count(*), " + str(MOST_OCCURRENCES) + ") + 1), lambda j: 1.0 / CAST(j * j AS DOUBLE))) AS weight FROM (SELECT {id} AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {source}) GROUP BY id, term)"


def frame_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query, term``: the terms of each frame, from its first 24 query terms."""
    joined = F.array_join(T.query_terms(F.col("text")), " ")
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.regexp_extract_all(joined, F.lit("[a-z0-9]+"), 0)).alias("term")).distinct()


def evidence_postings(spark: SparkSession, sf_dir: str, terms: DataFrame) -> DataFrame:
    return build_postings(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), terms)


def _ranked_sql(every: bool) -> str:
    return f"""WITH {_TERMS_SQL}, {_WEIGHTS_SQL.format(name="w", id="doc_id", source="documents")},
        s AS (SELECT q.query, w.id, round(sum(w.weight), 9) AS raw, count(*) AS found FROM q JOIN w ON w.term = q.term GROUP BY 1, 2),
        r AS (SELECT s.query, id, raw, terms, CAST(row_number() OVER (PARTITION BY s.query ORDER BY raw DESC, id) AS INTEGER) AS rank FROM s JOIN n ON n.query = s.query {"WHERE found = terms" if every else ""})
        SELECT query, id, round(raw * {UNIT!r} / terms, 9) AS score, rank FROM r WHERE rank <= 20"""


@query("f05_ranked_or", _ranked_sql(False))
def ranked_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents of highest rank for any of a frame's terms."""
    terms = saved(frame_terms(spark, sf_dir))
    return search_postings(evidence_postings(spark, sf_dir, terms), terms, 20).withColumn("score", F.round("score", 9))


@query("f05_ranked_and", _ranked_sql(True))
def ranked_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of those that hold all of them."""
    terms = saved(frame_terms(spark, sf_dir))
    return search_postings(evidence_postings(spark, sf_dir, terms), terms, 20, every=True).withColumn("score", F.round("score", 9))


def playbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text, embedding, domain, risk, pattern, published`` of the approved ones."""
    vectors = load(spark, sf_dir, "embeddings").where("vec_id % 7 <> 0")
    texts = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    domain = F.when(F.col("label") % 4 != 0, F.col("label") % 4).cast("long")
    return vectors.join(texts, "vec_id").select(F.col("vec_id").alias("id"), "text", "embedding", domain.alias("domain"), (F.col("vec_id") % 6).alias("risk"), (F.col("vec_id") % 150).alias("pattern"), (F.col("vec_id") % 5 != 0).alias("published"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query, domain, cap, signature, embedding``: what each frame asks for; some name no domain."""
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.when(F.col("item_id") % 4 != 0, F.col("item_id") % 4).alias("domain"), (2 + F.col("item_id") % 4).alias("cap"), (F.col("item_id") % 100).alias("signature"))
    return items.join(load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query"), "embedding"), "query")


_ARMS_SQL = f"""WITH {_TERMS_SQL},
    p AS (SELECT vec_id AS id, text, embedding, CASE WHEN label % 4 <> 0 THEN CAST(label % 4 AS BIGINT) END AS domain, vec_id % 6 AS risk, vec_id % 150 AS pattern, vec_id % 5 <> 0 AS published FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 7 <> 0),
    c AS (SELECT item_id AS query, CASE WHEN item_id % 4 <> 0 THEN item_id % 4 END AS domain, 2 + item_id % 4 AS cap, item_id % 100 AS signature, embedding FROM benchmark JOIN embeddings ON vec_id = item_id),
    m AS (SELECT c.query, c.cap, c.signature, c.embedding AS v, p.id, p.embedding AS w, p.risk, p.pattern, p.published FROM c JOIN p ON c.domain IS NULL OR p.domain IS NULL OR p.domain = c.domain),
    e1 AS (SELECT query, id, risk, cap, row_number() OVER (PARTITION BY query ORDER BY round({_COS.format("w", "v")}, 9) + 0.0, id) AS r FROM m),
    {_WEIGHTS_SQL.format(name="pw", id="id", source="p")}, {_WEIGHTS_SQL.format(name="dw", id="doc_id", source="documents")},
    e2 AS (SELECT m.query, m.id, m.risk, m.cap, row_number() OVER (PARTITION BY m.query ORDER BY s.raw DESC, m.id) AS r FROM (SELECT q.query, pw.id, round(sum(weight), 9) AS raw FROM q JOIN pw ON pw.term = q.term GROUP BY 1, 2) s JOIN m ON m.query = s.query AND m.id = s.id),
    ep AS (SELECT query, user_id % 150 AS pattern FROM (SELECT c.query, event_id, user_id, row_number() OVER (PARTITION BY c.query ORDER BY event_id) AS r FROM c JOIN events ON CAST(json_extract_string(props, '$.k') AS BIGINT) = c.signature AND event_type <> 'error') WHERE r <= {EPISODES}),
    e3 AS (SELECT m.query, m.id, m.risk, m.cap, row_number() OVER (PARTITION BY m.query ORDER BY m.id) AS r FROM m WHERE (m.query, m.pattern) IN (SELECT query, pattern FROM ep)),
    ev AS (SELECT query, id FROM (SELECT q.query, dw.id, row_number() OVER (PARTITION BY q.query ORDER BY round(sum(weight), 9) DESC, dw.id) AS r FROM q JOIN dw ON dw.term = q.term GROUP BY q.query, dw.id) WHERE r <= {EVIDENCE_HITS}),
    e4 AS (SELECT m.query, m.id, m.risk, m.cap, row_number() OVER (PARTITION BY m.query ORDER BY m.id) AS r FROM m WHERE published AND (m.query, m.id) IN (SELECT query, id * 3 % 500 FROM ev)),
    a AS (SELECT 'signature' AS arm, 1 AS prio, {ARM_CAPS["signature"]} AS most, * FROM e3 UNION ALL SELECT 'embedding', 2, {ARM_CAPS["embedding"]}, * FROM e1 UNION ALL SELECT 'lexical', 3, {ARM_CAPS["lexical"]}, * FROM e2 UNION ALL SELECT 'evidence', 4, {ARM_CAPS["evidence"]}, * FROM e4),
    k AS (SELECT query, id, arm, prio, most, row_number() OVER (PARTITION BY query, arm ORDER BY r) AS rank FROM a WHERE r <= most * {OVERSAMPLE} AND risk <= cap),
    u AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY min(prio * 1000 + rank), id) AS place FROM k WHERE rank <= most GROUP BY query, id),
    o AS (SELECT query, id, place FROM u WHERE place <= {UNION_CAP})
    SELECT o.query, o.id, CAST(o.place AS INTEGER) AS place, CAST(max(CASE WHEN arm = 'signature' THEN rank END) AS INTEGER) AS signature, CAST(max(CASE WHEN arm = 'embedding' THEN rank END) AS INTEGER) AS embedding,
        CAST(max(CASE WHEN arm = 'lexical' THEN rank END) AS INTEGER) AS lexical, CAST(max(CASE WHEN arm = 'evidence' THEN rank END) AS INTEGER) AS evidence FROM o JOIN k ON k.query = o.query AND k.id = o.id AND k.rank <= k.most GROUP BY 1, 2, 3"""


@query("g18_four_arms", _ARMS_SQL)
def four_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each frame the candidates of four arms, at most 60 of all, with their rank in each.

    Signature: playbooks of the patterns of (80) approved episodes that show
    the frame's signature.  Embedding and lexical: the nearest and the best
    by rank.  Evidence: published playbooks that the 40 best documents are
    linked with.  Each arm sees what the frame's domain admits, looks at
    three times its cap and keeps what the frame's risk cap admits.
    """
    books, cases, terms = saved(playbooks(spark, sf_dir)), saved(frames(spark, sf_dir)), saved(frame_terms(spark, sf_dir))
    about, asking = books.select("id", F.col("domain").alias("of"), "risk", "pattern", "published"), cases.select("query", "domain", "cap", "signature")

    def admitted(rows: DataFrame) -> DataFrame:
        """Rows (query, id, ...) that the frame's domain admits, with what is known of both."""
        return rows.join(about, "id").join(asking, "query").where(F.col("domain").isNull() | F.col("of").isNull() | (F.col("domain") == F.col("of")))

    def arm(rows: DataFrame, name: str, *order) -> DataFrame:
        most = ARM_CAPS[name]
        seen = rows.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("r") <= most * OVERSAMPLE).where(F.col("risk") <= F.col("cap"))
        return seen.select("query", "id", F.lit(name).alias("arm"), F.row_number().over(Window.partitionBy("query").orderBy("r")).alias("rank")).where(F.col("rank") <= most)

    # A frame asks in every domain that it admits; its own number and the domain's make one query of the index.
    domain = F.coalesce(F.col("domain"), F.lit(0))
    index = build_index(books.select("id", domain.alias("space"), "embedding"))
    spaces = F.when(F.col("domain").isNull(), F.array(*map(F.lit, range(4)))).otherwise(F.array(F.lit(0), F.col("domain").cast("int")))
    wide = cases.select("query", "embedding", F.explode(spaces).alias("space")).select((F.col("query") * 4 + F.col("space")).alias("id"), F.col("space").cast("string").alias("space"), "embedding")
    near = search(index, wide, ARM_CAPS["embedding"] * OVERSAMPLE, within=True).select(F.expr("query div 4").alias("query"), "id", "distance")
    embedding = arm(admitted(near), "embedding", "distance", "id")

    scored = search_postings(build_postings(books.select("id", "text"), terms), terms, ARM_CAPS["lexical"] * OVERSAMPLE, keep=admitted)
    lexical = arm(admitted(scored), "lexical", "rank")

    events = load(spark, sf_dir, "events").where("event_type <> 'error'").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("signature"))
    shown = events.join(F.broadcast(asking.select("query", "signature")), "signature")
    first = shown.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("event_id"))).where(F.col("r") <= EPISODES)
    patterns = first.select("query", (F.col("user_id") % 150).alias("pattern")).distinct()
    signature = arm(admitted(patterns.join(books.select("id", "pattern"), "pattern").select("query", "id")), "signature", "id")

    hits = search_postings(evidence_postings(spark, sf_dir, terms), terms, EVIDENCE_HITS)
    linked = hits.select("query", (F.col("id") * 3 % 500).alias("id")).distinct()
    evidence = arm(admitted(linked).where("published"), "evidence", "id")

    ranks = saved(signature.unionByName(embedding).unionByName(lexical).unionByName(evidence))
    turn = F.array_position(F.array(*map(F.lit, ARM_CAPS)), F.col("arm")) * 1000 + F.col("rank")
    at = {name: F.max(F.when(F.col("arm") == name, F.col("rank"))).alias(name) for name in ARM_CAPS}
    union = ranks.groupBy("query", "id").agg(F.min(turn).alias("turn"), *at.values())
    place = F.row_number().over(Window.partitionBy("query").orderBy("turn", "id"))
    return union.withColumn("place", place).where(F.col("place") <= UNION_CAP).select("query", "id", "place", *ARM_CAPS)
