"""Identities: which mentions in texts may become one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import identity as I
from tessera.operators.names import resolve
from tessera.plans.registry import load, query

#: Fixed expressions of both engines: the type and the identifier of the mention that each document's text gives.
_TYPE = "CASE doc_id % 7 WHEN 0 THEN 'person' WHEN 1 THEN 'service' WHEN 2 THEN 'application' WHEN 3 THEN 'device' WHEN 4 THEN 'version' WHEN 5 THEN 'service' ELSE 'process' END"
_IDENTIFIER = "CASE doc_id % 11 WHEN 0 THEN 'email' WHEN 1 THEN 'external_id' WHEN 2 THEN 'hostname' END"

_SQL_LIST = lambda values: ", ".join(f"'{v}'" for v in values)


@query(
    "f39_identity_candidacy",
    f"""WITH m AS (SELECT doc_id, {_TYPE} AS entity_type, {_IDENTIFIER} AS identifier, array_to_string(list_slice(string_split(text, ' '), 2, 2 + doc_id % 5), ' ') AS name FROM documents),
        w AS (SELECT *, trim(regexp_replace(name, '[\\s\\p{{Z}}]+', ' ', 'g')) AS t FROM m),
        s AS (SELECT *, coalesce(length(t) >= 2 AND NOT regexp_matches(t, '{I.QUOTES.replace("'", "''")}') AND len(string_split(t, ' ')) <= {I.MOST_NAME_WORDS}
            AND len(list_filter(string_split(t, ' '), lambda x: regexp_matches(x, '{I.LETTER}') AND (regexp_matches(x, '{I.CAPITAL}') OR regexp_matches(x, '{I.INSIDE}')))) > 0, false) AS shaped FROM w)
        SELECT doc_id, entity_type, name, CASE WHEN identifier IN ({_SQL_LIST(I.SETTLING_IDENTIFIERS)}) THEN NULL WHEN entity_type IN ({_SQL_LIST(I.FACET_TYPES)}) THEN 'facet_type'
            WHEN entity_type NOT IN ({_SQL_LIST(I.IDENTITY_TYPES)}) THEN 'unsupported_type' WHEN NOT shaped THEN 'not_a_name' END AS reason FROM s""",
)
def identity_candidacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the mention of each document may not become an identity; null where it may."""
    name = F.array_join(F.slice(F.split("text", " "), F.lit(2), (F.col("doc_id") % 5 + 1).cast("int")), " ")
    rows = load(spark, sf_dir, "documents").select("doc_id", F.expr(_TYPE).alias("entity_type"), F.expr(_IDENTIFIER).alias("identifier"), name.alias("name"))
    return rows.select("doc_id", "entity_type", "name", I.rejection_reason(F.col("entity_type"), F.col("name"), F.array("identifier")).alias("reason"))


#: Fixed expressions of both engines: identities are parts, mentions are lines of orders that spell a part's name in six ways, a supplier's host belongs to the part of its number.
_KNOWN = "SELECT p_partkey AS identity, CASE p_partkey % 5 WHEN 0 THEN 'person' WHEN 1 THEN 'device' WHEN 2 THEN 'application' WHEN 3 THEN 'service' ELSE 'environment' END AS entity_type, p_name || ' ' || replace(p_brand, 'Brand#', 'b') || ' ' || p_type AS name, p_partkey % 13 <> 0 AS active FROM part"
_SPELT = """CASE (l_orderkey + l_linenumber) % 6 WHEN 0 THEN '  ' || upper(name) || '  ' WHEN 1 THEN name || 's' WHEN 2 THEN replace(name, ' b', '-b') WHEN 3 THEN 'Node' || l_suppkey WHEN 4 THEN split_part(name, ' ', 2) ELSE 'about ' || name || ' today' END"""
_MENTIONS = f"""SELECT entity_type, name, host, count(*) AS mentions FROM (SELECT CASE WHEN l_linenumber % 2 = 0 AND entity_type = 'application' THEN 'Service' ELSE entity_type END AS entity_type, {_SPELT} AS name, CASE WHEN l_orderkey % 17 = 0 THEN 'Host-' || l_suppkey END AS host FROM lineitem JOIN known ON identity = l_partkey) AS m GROUP BY entity_type, name, host"""
_KIND = "CASE WHEN lower(entity_type) IN ('application', 'service') THEN 'both' ELSE lower(entity_type) END"
_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(norm, '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_LONGEST = "list_slice(list_transform(list_sort(list_transform(list_distinct(list_filter(list_transform(string_split(norm, ' '), lambda w: trim(w, '.,-')), lambda w: length(w) >= 3)), lambda w: {'n': -length(w), 'w': w})), lambda x: x.w), 1, 3)"


@query(
    "g28_layered_resolver",
    f"""WITH known AS ({_KNOWN}), m AS ({_MENTIONS}), n AS (SELECT *, lower(trim(name)) AS norm, {_KIND} AS kind FROM m), k AS (SELECT identity, lower(name) AS norm, {_KIND} AS kind FROM known WHERE active),
        a AS (SELECT kind, norm, {_GRAMS} AS grams, {_LONGEST} AS longest FROM (SELECT DISTINCT kind, norm FROM n)), b AS (SELECT kind, norm, {_GRAMS} AS grams FROM (SELECT DISTINCT kind, norm FROM k)),
        o AS (SELECT x.kind, x.norm, y.norm AS known, count(*) AS common FROM (SELECT kind, norm, unnest(grams) AS g FROM a) x JOIN (SELECT kind, norm, unnest(grams) AS g FROM b) y ON x.kind = y.kind AND x.g = y.g GROUP BY ALL),
        p AS (SELECT a.kind, a.norm, b.norm AS known, coalesce(common, 0) AS common, len(a.grams) + len(b.grams) - coalesce(common, 0) AS whole FROM a JOIN b ON a.kind = b.kind LEFT JOIN o ON o.kind = a.kind AND o.norm = a.norm AND o.known = b.norm
            WHERE 10 * coalesce(common, 0) > 3 * (len(a.grams) + len(b.grams) - coalesce(common, 0)) OR len(list_filter(a.longest, lambda w: contains(b.norm, w))) > 0),
        r AS (SELECT p.kind, p.norm, k.identity, p.common::DOUBLE / p.whole AS similarity, row_number() OVER (PARTITION BY p.kind, p.norm ORDER BY p.common::DOUBLE / p.whole DESC, p.known, k.identity) AS place FROM p JOIN k ON k.kind = p.kind AND k.norm = p.known),
        c AS (SELECT kind, norm, max(CASE WHEN place = 1 THEN identity END) AS best, max(CASE WHEN place = 1 THEN similarity END) AS s1, max(CASE WHEN place = 2 THEN similarity END) AS s2, string_agg(identity, ',' ORDER BY place) AS candidates FROM r WHERE place <= 5 GROUP BY 1, 2),
        e AS (SELECT kind, norm, min(identity) AS exact FROM k GROUP BY 1, 2),
        d AS (SELECT n.*, s_suppkey AS owner, exact, best, s1, s2, candidates, lower(entity_type) AS t, len(string_split(trim(name), ' ')) <= 4 AND len(list_filter(string_split(trim(name), ' '), lambda x: regexp_matches(x, '{I.LETTER}') AND (regexp_matches(x, '{I.CAPITAL}') OR regexp_matches(x, '{I.INSIDE}')))) > 0 AS shaped
            FROM n LEFT JOIN supplier ON lower(host) = 'host-' || s_suppkey LEFT JOIN e ON e.kind = n.kind AND e.norm = n.norm LEFT JOIN c ON c.kind = n.kind AND c.norm = n.norm),
        v AS (SELECT *, CASE WHEN owner IS NOT NULL THEN 'strong:hostname' WHEN exact IS NOT NULL THEN 'alias_exact' WHEN host IS NOT NULL THEN NULL WHEN t = 'environment' THEN 'facet_type' WHEN NOT shaped THEN 'not_a_name' END AS reason FROM d),
        w AS (SELECT *, coalesce(reason, CASE WHEN best IS NULL THEN 'provisional' WHEN s2 IS NOT NULL AND s1 = s2 THEN 'abstained' WHEN round(s1, 6) >= CASE WHEN t = 'person' THEN 0.95 ELSE 0.9 END THEN 'adjudicated' ELSE 'below_threshold' END) AS method FROM v)
        SELECT entity_type, name, host, mentions, method, CASE method WHEN 'strong:hostname' THEN owner WHEN 'alias_exact' THEN exact WHEN 'adjudicated' THEN best END AS identity,
            CASE method WHEN 'strong:hostname' THEN 1.0 WHEN 'alias_exact' THEN 0.95 WHEN 'adjudicated' THEN round(s1, 6) WHEN 'abstained' THEN round(s1, 6) WHEN 'below_threshold' THEN round(s1, 6) WHEN 'provisional' THEN 0.5 END::DOUBLE AS confidence, CASE WHEN reason IS NULL THEN candidates END AS candidates FROM w""",
)
def layered_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct mention, resolved by identifier, exact name, or the nearest of the five nearest names."""
    part, supplier, lineitem = (load(spark, sf_dir, t) for t in ("part", "supplier", "lineitem"))
    known = spark.sql(_KNOWN.replace("FROM part", "FROM {part}"), part=part)
    mentions = spark.sql(_MENTIONS.replace("FROM lineitem JOIN known", "FROM {lineitem} JOIN {known}"), lineitem=lineitem, known=known)
    strong = F.when(F.col("host").isNotNull(), F.array(F.struct(F.lit("hostname").alias("kind"), F.col("host").alias("value")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    owners = supplier.select(F.lit("hostname").alias("kind"), F.concat(F.lit("host-"), F.col("s_suppkey").cast("string")).alias("value"), F.col("s_suppkey").alias("identity"))
    found = resolve(mentions.withColumn("strong", strong), known, known.select("identity", F.col("name").alias("alias")), owners)
    return found.select("entity_type", "name", "host", "mentions", "method", "identity", "confidence", F.array_join(F.transform("candidates", lambda c: c["identity"].cast("string")), ",").alias("candidates"))
