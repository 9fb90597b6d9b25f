"""Content rules: literal fragments, conversational references, applicability verdicts, content hashes, text to embed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.canonical import canonical_json
from tessera.plans.registry import load, query

#: Marks around a word, and the rule for what looks like a path, flag or dotted name.
_AROUND = r"""^[.,;:"'()\[\]]+|[.,;:"'()\[\]]+$"""
_LITERAL = r"[-/\\._=]"
_PIECE = r"[^ \t\n\r]+"
MOST_FRAGMENTS = 8

#: How people refer to a case by a person or by a thing.
OWNER_REFERENCE = r"\b([A-Z][\w.-]+(?:\s+[A-Z][\w.-]+){0,2})'s\s+(?:ticket|incident|case)\b"
THING_REFERENCE = r"(?i)\b(?:ticket|incident|case)\s+(?:for|about|on)\s+(?:the\s+)?([\w][\w /.-]{2,60})"

#: How much further an article ranks that names another component, or another deployment.
COMPONENT_PENALTY, DEPLOYMENT_PENALTY = 1.6, 1.5

#: Labels of a version that are embedded, and characters in all.
MOST_LABELS, MOST_EMBEDDED = 20, 8000


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def literal_fragments(text: Column) -> Column:
    """The first words of a text that look like paths, flags or dotted names."""
    bare = F.transform(F.regexp_extract_all(text, F.lit(_PIECE), 0), lambda x: F.regexp_replace(x, _AROUND, ""))
    return F.slice(F.filter(bare, lambda x: (F.length(x) >= 4) & x.rlike(_LITERAL)), 1, MOST_FRAGMENTS)


@query(
    "f09_literal_fragments",
    f"SELECT doc_id, array_to_string(list_slice(list_filter(list_transform(regexp_extract_all(text, '{_PIECE}'), lambda x: regexp_replace(x, '{_quoted(_AROUND)}', '', 'g')), lambda x: length(x) >= 4 AND regexp_matches(x, '{_LITERAL}')), 1, {MOST_FRAGMENTS}), ' ') AS fragments FROM documents",
)
def literal_fragment_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(literal_fragments(F.col("text")), " ").alias("fragments"))


@query(
    "f37_reference_triggers",
    f"""WITH t AS (SELECT 'nation' AS kind, n_nationkey::BIGINT AS id, 0::BIGINT AS turn, 'reopen Ana ' || n_name || '''s ticket, see the Incident about the gateway ' || n_nationkey AS text FROM nation UNION ALL SELECT 'turn', conv_id, turn, text FROM conversations)
SELECT kind, id, turn, array_to_string(regexp_extract_all(text, '{_quoted(OWNER_REFERENCE)}', 1), '|') AS people, lower(array_to_string(regexp_extract_all(text, '{_quoted(THING_REFERENCE)}', 1), '|')) AS things FROM t""",
)
def reference_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = load(spark, sf_dir, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("id"), F.lit(0).cast("long").alias("turn"), F.concat(F.lit("reopen Ana "), "n_name", F.lit("'s ticket, see the Incident about the gateway "), F.col("n_nationkey").cast("string")).alias("text"))
    turns = load(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), "turn", "text")
    found = lambda pattern: F.array_join(F.regexp_extract_all("text", F.lit(pattern), 1), "|")
    return nations.unionByName(turns).select("kind", "id", "turn", found(OWNER_REFERENCE).alias("people"), F.lower(found(THING_REFERENCE)).alias("things"))


def applicability(components: Column, deployments: Column, target_components: Column, target_deployments: Column) -> tuple[Column, Column]:
    """Verdict and rank penalty; only what both sides state can count against an article."""
    stated = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0)
    other_component = stated(components, target_components) & ~F.arrays_overlap(components, target_components)
    other_deployment = stated(deployments, target_deployments) & ~F.arrays_overlap(deployments, target_deployments)
    compared = stated(components, target_components) | stated(deployments, target_deployments)
    verdict = F.when(other_component | other_deployment, "mismatch").when(compared, "applies").otherwise("unknown")
    return verdict, F.when(other_component, COMPONENT_PENALTY).otherwise(1.0) * F.when(other_deployment, DEPLOYMENT_PENALTY).otherwise(1.0)


@query(
    "f29_applicability_compare",
    """WITH a AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 4 END AS component, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'hosted' ELSE 'local' END AS deployment FROM part)
SELECT p_partkey, CASE WHEN component = 3 OR deployment = 'local' THEN 'mismatch' WHEN component IS NOT NULL OR deployment IS NOT NULL THEN 'applies' ELSE 'unknown' END AS verdict, (CASE WHEN component = 3 THEN 1.6 ELSE 1.0 END * CASE WHEN deployment = 'local' THEN 1.5 ELSE 1.0 END)::DOUBLE AS penalty FROM a""",
)
def applicability_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, place = F.col("p_size") % 4, F.col("p_size") % 3
    components = F.array_compact(F.array(F.when(kind != 0, kind)))
    deployments = F.array_compact(F.array(F.when(place == 1, "hosted").when(place == 2, "local")))
    verdict, penalty = applicability(components, deployments, F.array(F.lit(1), F.lit(2)), F.array(F.lit("hosted")))
    return load(spark, sf_dir, "part").select("p_partkey", verdict.alias("verdict"), penalty.alias("penalty"))


def content_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON of flat fields: keys in order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256)


_CANONICAL = """'{"Ab":"' || p_brand || '","a":{"c":"eA","k":-0.25},"b' || p_partkey % 3 || '":[3,100,0.5,{"x":true,"y":null}],"n":' || p_size || ',"z":1}'"""


@query("f54_content_hash", f"SELECT p_partkey, sha256({_CANONICAL}) AS content_hash FROM part")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of every record's canonical JSON, whatever the order of keys and the form of numbers."""
    parts = F.concat(F.lit('{"z": 1.0, "b'), (F.col("p_partkey") % 3).cast("string"), F.lit('": [3, 1e2, 0.5, {"y": null, "x": true}], "Ab": "'), "p_brand", F.lit('", "n": '), F.col("p_size").cast("string"), F.lit(r', "a": {"k": -0.25, "c": "e\u0041"}}'))
    return load(spark, sf_dir, "part").select("p_partkey", F.sha2(canonical_json(parts), 256).alias("content_hash"))


@query(
    "g60_embedding_text",
    f"""WITH l AS (SELECT l_orderkey, l_returnflag || ' ' || l_linestatus || ' ' || l_partkey AS label, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag || ' ' || l_linestatus || ' ' || l_partkey) AS k FROM lineitem),
t AS (SELECT l_orderkey, string_agg(label, ' ' ORDER BY k) AS labels FROM l WHERE k <= {MOST_LABELS} GROUP BY l_orderkey)
SELECT o_orderkey, left(trim(regexp_replace(concat_ws(' ', o_orderpriority, labels), '[ \t\n\r]+', ' ', 'g')), {MOST_EMBEDDED}) AS text FROM orders LEFT JOIN t ON o_orderkey = l_orderkey""",
)
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and the first labels of each record, whitespace folded; only the labels within the bound are gathered."""
    first = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "label")
    label = F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"))
    kept = load(spark, sf_dir, "lineitem").withColumn("label", label).select("l_orderkey", "label", F.row_number().over(first).alias("k")).where(F.col("k") <= MOST_LABELS)
    labels = kept.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "label"))), lambda x: x["label"]), " ").alias("labels"))
    joined = load(spark, sf_dir, "orders").join(labels, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.left(F.trim(F.regexp_replace(F.concat_ws(" ", "o_orderpriority", "labels"), r"[ \t\n\r]+", " ")), F.lit(MOST_EMBEDDED)).alias("text"))
