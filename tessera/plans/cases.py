"""Cases, conditions of playbooks and fixes, references between records, gaps and contradictions, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import cases as K
from tessera.functions import text as T
from tessera.operators.graph import saved
from tessera.operators.references import heal, newest, resolve
from tessera.operators.selection import select_connected
from tessera.operators.vectors import nearest_of_label
from tessera.plans.content import literal_fragments
from tessera.plans.registry import ORACLE_SQL, load, query


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(names) -> str:
    return ", ".join(map(_q, names))


# -- identifiers, frames, states -------------------------------------------------

#: The texts that identifiers are looked for in: a document with its source and a ticket number.
_SYMPTOM = "translate(text, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', 'ACEEEINOOUsaceeeinoou') || ' Host srv-' || (doc_id % 50) || '.lan says INC00' || (10000 + doc_id) || ' ASAP v1.' || (doc_id % 9) || ' ' || source"
_IDS = f"list_filter(list_transform(regexp_extract_all(blob, {_q(K.IDENTIFIER)}), lambda t: regexp_replace(t, '^[._-]+|[._-]+$', '', 'g')), lambda t: length(t) >= 3 AND upper(t) NOT IN ({_list(K.IDENTIFIER_STOPWORDS)}) AND regexp_matches(t, '[A-Za-z]'))"
_FIRST = "list_filter(list_transform(range(1, len({0}) + 1), lambda i: CASE WHEN list_position(list_transform({0}, lambda z: lower(z)), lower({0}[i])) = i THEN {0}[i] END), lambda t: t IS NOT NULL)"


@query("f32_identifiers", f"WITH b AS (SELECT doc_id, {_SYMPTOM} AS blob FROM documents), i AS (SELECT doc_id, {_IDS} AS x FROM b) SELECT doc_id, array_to_string(({_FIRST.format('x')})[1:8], ' ') AS ids FROM i")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight distinct identifiers of each text, the rule's own bound."""
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(K.identifiers(F.expr(_SYMPTOM)), " ").alias("ids"))


@query(
    "f31_case_frame",
    f"""WITH b AS (SELECT doc_id, {_SYMPTOM} AS symptom, [source, 'Team ' || (doc_id % 5)] AS ents FROM documents), c AS (SELECT *, symptom || ' ' || array_to_string(ents, ' ') AS blob FROM b),
       i AS (SELECT *, {_IDS} AS x, regexp_extract_all(symptom, '[A-Za-z]{{4,}}') AS words FROM c),
       u AS (SELECT doc_id, list_filter(list_transform(list_concat(({_FIRST.format('x')})[1:8], ents, words[greatest(len(words) - 15, 1):], regexp_extract_all(blob, '[A-Za-z0-9][A-Za-z0-9._-]{{1,}}')), lambda t: lower(t)), lambda t: t <> '') AS t FROM i),
       p AS (SELECT doc_id, term, min(n) AS n FROM (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS n FROM u) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS rn FROM p)
       SELECT doc_id, string_agg(term, ' ' ORDER BY n) AS terms FROM r WHERE rn <= 24 GROUP BY 1""",
)
def case_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24 terms of each case by priority, from the whole text."""
    entities = F.array("source", F.concat(F.lit("Team "), (F.col("doc_id") % 5).cast("string")))
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(K.lexical_terms(F.expr(_SYMPTOM), entities), " ").alias("terms"))


_SOURCE = "CASE o_orderkey % 3 WHEN 0 THEN 'Zoho_Desk ' WHEN 1 THEN 'servicenow' ELSE 'mail' END"
_OBJECT = "CASE o_orderkey % 3 WHEN 0 THEN 'tickets' WHEN 1 THEN CASE o_custkey % 4 WHEN 0 THEN 'incident' WHEN 1 THEN 'problem' WHEN 2 THEN 'sc_task' ELSE 'kb' END ELSE 'message' END"
_STATE = "CASE o_orderkey % 3 WHEN 0 THEN CASE o_custkey % 7 WHEN 0 THEN 'Closed' WHEN 1 THEN ' Resolved By Network Team' WHEN 2 THEN 'Open' WHEN 3 THEN 'Cancelled' WHEN 4 THEN 'Resolved - vendor' WHEN 5 THEN '' ELSE 'Resolved by Agent' END ELSE CAST(o_custkey % 10 AS VARCHAR(2)) END"


@query(
    "f35_case_state",
    f"""WITH p AS (SELECT o_orderkey, lower(trim({_SOURCE})) AS s, {_OBJECT} AS o, lower(trim({_STATE})) AS v FROM orders)
       SELECT o_orderkey, CASE WHEN s = 'zoho_desk' AND o = 'tickets' THEN CASE WHEN v IN ('closed', 'resolved', 'resolved by agent', 'resolved by plugin team') THEN 'resolved' WHEN v IN ('cancelled', 'canceled') THEN 'cancelled' WHEN starts_with(v, 'resolved by') OR starts_with(v, 'resolved -') THEN 'resolved' END
         WHEN s = 'servicenow' AND o IN ('incident', 'problem', 'sc_req_item', 'sc_task') THEN CASE WHEN v IN ('6', '7', 'resolved', 'closed') THEN 'resolved' WHEN v IN ('8', 'canceled', 'cancelled') THEN 'cancelled' END END AS state FROM p""",
)
def case_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each record's source says of its end; the field depends on source and object."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.expr(_SOURCE).alias("source"), F.expr(_OBJECT).alias("object"), F.expr(_STATE).alias("value"))
    fields = F.when(F.col("object") == "tickets", F.create_map(F.lit("status"), "value")).otherwise(F.create_map(F.lit("state"), "value", F.lit("priority"), F.lit("3")))
    return o.select("o_orderkey", K.case_state(F.col("source"), F.col("object"), fields).alias("state"))


_LABEL = "CASE o_orderkey % 12 WHEN 0 THEN 'PROD-EU2' WHEN 1 THEN 'Non-Prod' WHEN 2 THEN 'Pre-Prod EU' WHEN 3 THEN 'QA2' WHEN 4 THEN 'uat' WHEN 5 THEN 'dev box ' || o_custkey WHEN 6 THEN 'P' WHEN 7 THEN 'the LIVE site' WHEN 8 THEN 'unknown' WHEN 9 THEN '' WHEN 10 THEN 'nonprd7' ELSE 'Stg' || o_custkey END"
_ALIASES = ", ".join(f"('{k}', '{v}')" for k, v in K.ENVIRONMENTS.items())


@query(
    "f28_environment_labels",
    f"""WITH k AS (SELECT o_orderkey, trim(regexp_replace(lower({_LABEL}), '[^a-z0-9]+', ' ', 'g')) AS key FROM orders), b AS (SELECT o_orderkey, key, ' ' || trim(regexp_replace(key, '\\b([a-z]+)\\d+\\b', '\\1', 'g')) || ' ' AS bare FROM k),
       m AS (SELECT o_orderkey, tier, row_number() OVER (PARTITION BY o_orderkey ORDER BY length(alias) DESC) AS rn FROM b JOIN (VALUES {_ALIASES}) a(alias, tier) ON contains(bare, ' ' || alias || ' ') WHERE NOT regexp_matches(key, '\\bnon\\s?(?:prod|production|prd|live)\\b'))
       SELECT o.o_orderkey, tier FROM orders o LEFT JOIN m ON m.o_orderkey = o.o_orderkey AND rn = 1""",
)
def environment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tier that each record's own label of its environment names, if it names one."""
    return load(spark, sf_dir, "orders").select("o_orderkey", K.environment_tier(F.expr(_LABEL)).alias("tier"))


# -- conditions ------------------------------------------------------------------

_PAIRS = "pairs AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)"


def supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every playbook (part) with every case (supplier) it met."""
    lines = load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return lines.join(load(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).join(load(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))


@query(
    "f30_trigger_gate",
    f"""WITH {_PAIRS}, c AS (SELECT l_partkey, l_suppkey, p_partkey % 29 = 0 AS expired, p_partkey % 5 = 0 AS conflicts, lower(s_name) || ' disk replica' AS haystack,
         CASE WHEN p_partkey % 4 <> 0 THEN 'Rel' || (p_partkey % 3) END AS want_product, CASE WHEN l_suppkey % 8 <> 0 THEN 'rel' || (l_suppkey % 3) || ' sp1' END AS product,
         CASE WHEN p_partkey % 3 = 0 THEN 'os' || (p_partkey % 2) END AS want_os, CASE WHEN l_suppkey % 7 <> 0 THEN 'os' || (l_suppkey % 2) END AS os,
         CASE WHEN p_partkey % 6 = 1 THEN 'r' || (p_partkey % 5) END AS bad_region, 'r' || (l_suppkey % 5) AS region,
         CASE WHEN p_partkey % 7 < 3 THEN ['replica lag', 'tiny'] WHEN p_partkey % 7 = 3 THEN ['an ox', 'disk full'] ELSE ['printer jam'] END AS loose FROM pairs JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
       k AS (SELECT *, CASE WHEN want_product IS NULL THEN NULL WHEN product IS NULL THEN 'missing' WHEN contains(product, lower(want_product)) THEN 'matched' ELSE 'other' END AS kp, CASE WHEN want_os IS NULL THEN NULL WHEN os IS NULL THEN 'missing' WHEN os = want_os THEN 'matched' ELSE 'other' END AS ko,
         list_transform(list_filter(loose, lambda f: regexp_matches(f, '[A-Za-z0-9._-]{{4,}}')), lambda f: CASE WHEN len(list_filter(regexp_extract_all(f, '[A-Za-z0-9][A-Za-z0-9._-]{{1,}}'), lambda t: length(t) >= 4 AND contains(haystack, t))) > 0 THEN 'matched' ELSE 'missing' END) AS kl FROM c),
       n AS (SELECT *, list_filter(list_concat([kp, ko], kl), lambda x: x IS NOT NULL) AS states FROM k), m AS (SELECT *, len(states) AS evaluated, len(list_filter(states, lambda x: x = 'matched')) AS matched, len(list_filter(states, lambda x: x = 'missing')) AS missing FROM n),
       d AS (SELECT *, CASE WHEN expired THEN 'expired' WHEN bad_region = region THEN 'environment_excluded' WHEN kp = 'other' OR ko = 'other' THEN 'environment_mismatch' END AS reason FROM m)
       SELECT l_partkey, l_suppkey, CASE WHEN reason IS NOT NULL THEN 'contradicted' WHEN evaluated = 0 THEN 'unvalidated' WHEN missing = 0 AND evaluated >= 2 AND NOT conflicts THEN 'exact' WHEN missing = 0 THEN 'strong' WHEN matched / evaluated >= 0.7 AND matched >= 2 THEN 'strong' WHEN matched > 0 THEN 'partial' ELSE 'unvalidated' END AS level, reason IS NOT NULL AS dropped, reason FROM d""",
)
def trigger_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each playbook's conditions fit each case; dropped where they contradict."""
    text = lambda prefix, key, n: F.concat(F.lit(prefix), (F.col(key) % n).cast("string"))
    entry = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("key"), value.alias("value")))
    as_map = lambda *entries: F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))
    requires = as_map(entry("Product", F.when(F.col("p_partkey") % 4 != 0, text("Rel", "p_partkey", 3))), entry(" os", F.when(F.col("p_partkey") % 3 == 0, text("os", "p_partkey", 2))))
    excludes = as_map(entry("region", F.when(F.col("p_partkey") % 6 == 1, text("r", "p_partkey", 5))))
    env = as_map(entry("product", F.when(F.col("l_suppkey") % 8 != 0, F.concat(text("rel", "l_suppkey", 3), F.lit(" sp1")))), entry("os", F.when(F.col("l_suppkey") % 7 != 0, text("os", "l_suppkey", 2))), entry("region", text("r", "l_suppkey", 5)))
    words = lambda *x: F.array(*map(F.lit, x))
    loose = F.when(F.col("p_partkey") % 7 < 3, words("replica lag", "tiny")).when(F.col("p_partkey") % 7 == 3, words("an ox", "disk full")).otherwise(words("printer jam"))
    verdict = K.trigger_verdict(requires, loose, excludes, env, F.concat(F.col("s_name"), F.lit(" disk replica")), F.col("p_partkey") % 29 == 0, F.col("p_partkey") % 5 == 0)
    return supplied(spark, sf_dir).select("l_partkey", "l_suppkey", verdict.alias("v")).select("l_partkey", "l_suppkey", "v.level", F.col("v.drop").alias("dropped"), "v.reason")


@query(
    "f50_fix_applicability",
    f"""WITH {_PAIRS}, c AS (SELECT l_partkey AS f, l_suppkey AS t, l_partkey = l_suppkey AS exact, CASE WHEN l_partkey % 3 > 0 THEN 'm' || (l_partkey % 4) END AS rm, 'm' || (l_suppkey % 4) AS tm, CASE WHEN l_partkey % 2 = 0 THEN 'b' || (l_partkey % 3) END AS rb, 'b' || (l_suppkey % 3) AS tb,
         CASE WHEN l_partkey % 5 < 3 THEN 'Net Card ' || (l_partkey % 2) END AS rc, 'net  card ' || (l_suppkey % 2) AS tc, CASE WHEN l_partkey % 7 = 0 THEN 'z' || (l_partkey % 6) END AS xs, 'z' || (l_suppkey % 6) AS ts, CASE WHEN l_partkey % 11 > 0 THEN 'c' || (l_partkey % 6) END AS rk, 'c' || (l_suppkey % 6) AS tk, 'c' || (l_suppkey % 6 // 2) AS up FROM pairs),
       v AS (SELECT *, CASE WHEN xs = ts THEN 'excluded_trait' WHEN rm <> tm OR rb <> tb OR lower(rc) <> regexp_replace(tc, '\\s+', ' ', 'g') THEN 'required_trait_not_validated' END AS rejected, coalesce(rk = tk, false) AS same_c, coalesce(rk = tk OR rk = up, false) AS rel FROM c),
       l AS (SELECT *, CASE WHEN exact THEN 'exact_ci' WHEN rm IS NOT NULL AND rb IS NOT NULL THEN 'same_model_and_configuration' WHEN rc IS NOT NULL AND (same_c OR rel OR rk IS NULL) THEN 'same_component_or_version' WHEN rc IS NOT NULL THEN 'cross_class_capability' WHEN same_c THEN 'same_ci_class' WHEN rel THEN 'related_ci_class' ELSE 'semantic_only' END AS level FROM v),
       s AS (SELECT *, (rm IS NOT NULL)::INT * 0.10 + (rb IS NOT NULL)::INT * 0.10 + (rc IS NOT NULL)::INT * 0.20 + CASE WHEN same_c THEN 0.10 WHEN rel THEN 0.05 ELSE 0 END - CASE WHEN level = 'cross_class_capability' THEN 0.05 ELSE 0 END AS score FROM l)
       SELECT f AS fix, t AS target, level, CAST(round(least(greatest(score, CASE level WHEN 'exact_ci' THEN 0.95 WHEN 'same_model_and_configuration' THEN 0.9 ELSE 0 END, 0), 1), 2) AS DOUBLE) AS score FROM s WHERE rejected IS NULL""",
)
def fix_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and level of every fix (part) for the targets (suppliers) that it may serve."""
    text = lambda prefix, key, n: F.concat(F.lit(prefix), (F.col(key) % n).cast("string"))
    entry = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("key"), value.alias("value")))
    as_map = lambda *entries: F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))
    p = "l_partkey"
    required = as_map(entry("model", F.when(F.col(p) % 3 > 0, text("m", p, 4))), entry("os_build", F.when(F.col(p) % 2 == 0, text("b", p, 3))), entry("component", F.when(F.col(p) % 5 < 3, text("Net Card ", p, 2))))
    excluded = as_map(entry("site", F.when(F.col(p) % 7 == 0, text("z", p, 6))))
    traits = as_map(entry("model", text("m", "l_suppkey", 4)), entry("os_build", text("b", "l_suppkey", 3)), entry("component", text("net  card ", "l_suppkey", 2)), entry("site", text("z", "l_suppkey", 6)))
    own, above = text("c", "l_suppkey", 6), F.concat(F.lit("c"), F.expr("l_suppkey % 6 div 2").cast("string"))
    verdict = K.fix_verdict(required, excluded, traits, F.col(p) == F.col("l_suppkey"), F.when(F.col(p) % 11 > 0, text("c", p, 6)), own, F.array(own, above))
    lines = load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return lines.select(F.col(p).alias("fix"), F.col("l_suppkey").alias("target"), verdict.alias("v")).where("v.rejected IS NULL").select("fix", "target", "v.level", "v.score")


# -- support of claims -----------------------------------------------------------

_TOK = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
_NEG = f"regexp_matches(regexp_split_to_array(lower({{0}}), {_q('\\b(?:' + '|'.join(T.CLAUSE_BREAKS) + ')\\b')})[1], {_q('\\b(?:' + '|'.join(T.NEGATION_CUES) + ')\\b')})"
_NEIGHBOURS = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"


@query(
    "g57_gap_answers",
    f"""WITH t AS (SELECT conv_id, turn, role, text, {_TOK.format('text')} AS k, {_NEG.format('text')} AS neg FROM conversations), s AS (SELECT *, list_sort(k) AS o FROM t),
       p AS (SELECT a.conv_id, a.turn, b.turn AS answer, a.k AS x, b.k AS y, {_NEIGHBOURS.format('a.o')} AS u, {_NEIGHBOURS.format('b.o')} AS v FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role <> 'user' AND a.neg = b.neg),
       c AS (SELECT conv_id, turn, answer, greatest(len(list_intersect(x, y)) / least(len(x), len(y)), CASE WHEN len(list_distinct(list_concat(u, v))) > 0 THEN len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v))) ELSE 0 END) AS score FROM p WHERE len(list_filter(list_intersect(x, y), lambda w: length(w) >= 4)) >= 2),
       r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(score, 9) DESC, answer) AS rn FROM c WHERE score >= 0.45) SELECT conv_id, turn, answer, round(score, 6) AS score FROM r WHERE rn = 1""",
)
def gap_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each question of a thread the turn of the thread that answers it best.

    It must agree in polarity, share two distinctive words and score 0.45.
    Threads are the context of a question; the join is by thread.
    """
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.tokens(F.col("text")).alias("k"), T.negated(F.col("text")).alias("neg"))
    a, b = turns.where("role = 'user'").alias("a"), turns.where("role <> 'user'").alias("b")
    pairs = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.neg") == F.col("b.neg")))
    shared = F.filter(F.array_intersect("a.k", "b.k"), lambda w: F.length(w) >= 4)
    score = F.greatest(T.overlap_coefficient(F.col("a.k"), F.col("b.k")), T.jaccard(T.sorted_pairs(F.col("a.k")), T.sorted_pairs(F.col("b.k"))))
    scored = pairs.where(F.size(shared) >= 2).select("a.conv_id", "a.turn", F.col("b.turn").alias("answer"), score.alias("score")).where("score >= 0.45")
    best = scored.groupBy("conv_id", "turn").agg(F.min(F.struct((-F.round("score", 9)).alias("d"), "answer", "score")).alias("b"))
    return best.select("conv_id", "turn", "b.answer", F.round("b.score", 6).alias("score"))


_FRAGS = r"""list_filter(list_transform(regexp_extract_all({0}, '\S+'), lambda p: regexp_replace(p, '^[.,;:"''()\[\]]+|[.,;:"''()\[\]]+$', '', 'g')), lambda p: length(p) >= 4 AND regexp_matches(p, '[/\\.\-_=]'))[1:8]"""
_STEP, _CLAIM = "'Open /etc/app' || (o_custkey % 40) || '.conf and set mode=' || (o_orderkey % 6) || ', then restart'", "'Set mode=' || (o_custkey % 6) || ' in ''/etc/app' || (o_orderkey % 40) || '.conf''.'"


@query("f09_literal_boost", f"WITH t AS (SELECT o_orderkey, {_STEP} AS step, {_CLAIM} AS claim FROM orders), f AS (SELECT *, {_FRAGS.format('claim')} AS frags, {_TOK.format('step')} AS x, {_TOK.format('claim')} AS y FROM t) SELECT o_orderkey, array_to_string(frags, ' ') AS fragments, round(greatest(len(list_intersect(x, y)) / least(len(x), len(y)), CASE WHEN len(list_filter(frags, lambda g: contains(lower(step), lower(g)))) > 0 THEN 0.85 ELSE 0 END), 6) AS support FROM f")
def literal_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of a step with its source's claim, at least 0.85 where the step repeats a literal of the claim."""
    step, claim = F.col("step"), F.col("claim")
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.expr(_STEP).alias("step"), F.expr(_CLAIM.replace("''/", "\\'/").replace("'''.'", "\\'.'")).alias("claim"))
    fragments = literal_fragments(claim)
    hit = F.exists(fragments, lambda g: F.lower(step).contains(F.lower(g)))
    return rows.select("o_orderkey", F.array_join(fragments, " ").alias("fragments"), F.round(F.greatest(T.overlap_coefficient(T.tokens(step), T.tokens(claim)), F.when(hit, 0.85).otherwise(0.0)), 6).alias("support"))


# -- references between records --------------------------------------------------


@query(
    "g45_reference_edges",
    """WITH t AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey DESC) AS rn, p_name, p_size FROM part), n AS (SELECT p_name, p_partkey, p_size FROM t WHERE rn = 1), r AS (SELECT DISTINCT l_orderkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey)
       SELECT l_orderkey, r.p_name AS name, CASE WHEN p_size > 25 THEN p_partkey END AS target, CASE WHEN p_size > 25 THEN 'resolved' ELSE 'unresolved' END AS state FROM r JOIN n ON n.p_name = r.p_name""",
)
def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by name to the newest record of that name, as far as it has arrived (size over 25)."""
    refs, records = _references(spark, sf_dir)
    return resolve(refs, newest(records, "name", ["version", "target"]).where("version > 25"), "name").select("l_orderkey", "name", "target", "state")


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = load(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("target"), F.col("p_size").alias("version"))
    refs = load(spark, sf_dir, "lineitem").join(parts, F.col("target") == F.col("l_partkey")).select("l_orderkey", "name").distinct()
    return refs, parts


@query(
    "g45_reverse_healing",
    """WITH t AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey DESC) AS rn, p_name, p_size FROM part), n AS (SELECT p_name, p_partkey, p_size FROM t WHERE rn = 1), r AS (SELECT DISTINCT l_orderkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey)
       SELECT l_orderkey, r.p_name AS name, CASE WHEN p_size > 10 THEN p_partkey END AS target, CASE WHEN p_size > 25 THEN 'resolved' WHEN p_size > 10 THEN 'healed' ELSE 'unresolved' END AS state FROM r JOIN n ON n.p_name = r.p_name""",
)
def reverse_healing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run after that, when records of sizes 11 to 25 have arrived late: only what was open is joined again."""
    refs, records = _references(spark, sf_dir)
    known = newest(records, "name", ["version", "target"])
    before = resolve(refs, known.where("version > 25"), "name")
    return heal(before, known.where("version > 10"), "name").select("l_orderkey", "name", "target", "state")


@query(
    "g46_link_graph",
    """WITH l AS (SELECT o_orderkey AS a, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey // 4 WHEN 1 THEN o_orderkey + 7 ELSE o_custkey END AS b, CASE o_orderkey % 4 WHEN 0 THEN 'is blocked by' WHEN 1 THEN 'blocks' WHEN 2 THEN 'relates to' ELSE 'duplicates' END AS t FROM orders),
       d AS (SELECT CASE WHEN t = 'is blocked by' THEN b WHEN t = 'relates to' THEN least(a, b) ELSE a END AS src, CASE WHEN t = 'is blocked by' THEN a WHEN t = 'relates to' THEN greatest(a, b) ELSE b END AS dst, CASE WHEN t IN ('is blocked by', 'blocks') THEN 'BLOCKS' WHEN t = 'duplicates' THEN 'DUPLICATES' ELSE 'RELATES_TO' END AS kind FROM l WHERE a <> b)
       SELECT src, dst, kind, bool_and(x.o_orderkey IS NOT NULL AND y.o_orderkey IS NOT NULL) AS resolved FROM d LEFT JOIN orders x ON x.o_orderkey = src LEFT JOIN orders y ON y.o_orderkey = dst GROUP BY 1, 2, 3""",
)
def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a tracker as edges: the two directions of one link are one edge, symmetric ones stand in order; ends that aren't there yet stay open."""
    o = load(spark, sf_dir, "orders")
    t = F.element_at(F.array(*map(F.lit, ("is blocked by", "blocks", "relates to", "duplicates"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    b = F.when(F.col("o_orderkey") % 4 == 0, F.expr("o_orderkey div 4")).when(F.col("o_orderkey") % 4 == 1, F.col("o_orderkey") + 7).otherwise(F.col("o_custkey"))
    links = o.select(F.col("o_orderkey").alias("a"), b.alias("b"), t.alias("t")).where("a <> b")
    inward, even = F.col("t") == "is blocked by", F.col("t") == "relates to"
    src, dst = F.when(inward, F.col("b")).when(even, F.least("a", "b")).otherwise(F.col("a")), F.when(inward, F.col("a")).when(even, F.greatest("a", "b")).otherwise(F.col("b"))
    kind = F.when(F.col("t").isin("is blocked by", "blocks"), "BLOCKS").when(F.col("t") == "duplicates", "DUPLICATES").otherwise("RELATES_TO")
    edges = links.select(src.alias("src"), dst.alias("dst"), kind.alias("kind")).distinct()
    there = o.select(F.col("o_orderkey").alias("key"))
    known = edges.join(there.withColumnRenamed("key", "src").withColumn("s", F.lit(True)), "src", "left").join(there.withColumnRenamed("key", "dst").withColumn("d", F.lit(True)), "dst", "left")
    return known.select("src", "dst", "kind", (F.col("s").isNotNull() & F.col("d").isNotNull()).alias("resolved"))


@query(
    "g47_asset_references",
    """WITH a AS (SELECT o_orderkey, unnest(['C' || o_custkey, 'N' || o_custkey % 40, CASE WHEN o_orderkey % 3 = 0 THEN 'C' || (o_custkey + 1) END]) AS ref FROM orders), k AS (SELECT 'C' || c_custkey AS ref, 'contact' AS kind FROM customer UNION ALL SELECT 'N' || n_nationkey, 'site' FROM nation)
       SELECT o_orderkey, a.ref, coalesce(kind, 'unresolved') AS kind FROM (SELECT DISTINCT * FROM a WHERE ref IS NOT NULL) a LEFT JOIN k ON k.ref = a.ref""",
)
def asset_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that each ticket's fields name, by their kind; one target table for all kinds."""
    key = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    named = F.array(key("C", F.col("o_custkey")), key("N", F.col("o_custkey") % 40), F.when(F.col("o_orderkey") % 3 == 0, key("C", F.col("o_custkey") + 1)))
    refs = load(spark, sf_dir, "orders").select("o_orderkey", F.explode(named).alias("ref")).where("ref IS NOT NULL").distinct()
    targets = load(spark, sf_dir, "customer").select(key("C", F.col("c_custkey")).alias("ref"), F.lit("contact").alias("kind")).unionByName(load(spark, sf_dir, "nation").select(key("N", F.col("n_nationkey")).alias("ref"), F.lit("site").alias("kind")))
    return refs.join(targets, "ref", "left").select("o_orderkey", "ref", F.coalesce("kind", F.lit("unresolved")).alias("kind"))


# -- contradictions, sweeps, replay, coverage --------------------------------------

_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


@query(
    "g37_contradiction_scan",
    f"""WITH p AS (SELECT a.vec_id AS step, b.vec_id AS article, round(1 - {_DOT}, 6) AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 10 = 3 AND b.vec_id % 10 <> 3), k AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY distance, article) AS rn FROM p),
       o AS (SELECT * FROM k WHERE rn <= 20 AND (step + article) % 4 <> 0), t AS (SELECT doc_id, list_filter({_TOK.format('text')}, lambda w: length(w) > 3) AS w FROM documents),
       g AS (SELECT step, article, distance FROM o JOIN t x ON x.doc_id = step JOIN t y ON y.doc_id = article WHERE len(list_intersect(x.w, y.w)) >= 2 OR (len(list_intersect(x.w, y.w)) = 1 AND least(len(x.w), len(y.w)) <= 3))
       SELECT step, article, distance FROM g ORDER BY distance, step, article LIMIT 500""",
)
def contradiction_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 500 pairs of a step and an article to compare.

    Steps are a stated tenth of the vectors; each sees its 20 nearest
    articles of its own subject, without the pairs that an earlier scan has
    seen, and only those that share enough words.  500 is the scan's budget.
    """
    near = nearest_of_label(load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding", (F.col("vec_id") % 10 == 3).alias("asks")), 20)
    fresh = saved(near.select(F.col("query").alias("step"), F.col("id").alias("article"), "distance").where((F.col("step") + F.col("article")) % 4 != 0))
    # Only texts that a pair names are cut into words.
    named = fresh.select(F.explode(F.array("step", "article")).alias("doc_id")).distinct()
    words = load(spark, sf_dir, "documents").join(named, "doc_id", "left_semi").select("doc_id", F.filter(T.tokens(F.col("text")), lambda w: F.length(w) > 3).alias("w"))
    both = fresh.join(words.select(F.col("doc_id").alias("step"), F.col("w").alias("x")), "step").join(words.select(F.col("doc_id").alias("article"), F.col("w").alias("y")), "article")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where((shared >= 2) | ((shared == 1) & (F.least(F.size("x"), F.size("y")) <= 3))).select("step", "article", "distance").orderBy(F.asc_nulls_last("distance"), "step", "article").limit(500)


@query(
    "g16_dedup_sweep",
    """WITH e AS (SELECT lower(regexp_replace(c_name, '[0-9]', '', 'g')) || c_nationkey AS key, c_custkey AS id FROM customer), p AS (SELECT lower(trim(p_name)) || '|' || p_brand AS key, p_partkey AS id FROM part), b AS (SELECT l_orderkey AS id, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS key FROM lineitem GROUP BY 1),
       u AS (SELECT 'entity' AS kind, key, id FROM e UNION ALL SELECT 'pattern', key, id FROM p UNION ALL SELECT 'playbook', key, id FROM b), k AS (SELECT kind, key, min(id) AS kept FROM u GROUP BY 1, 2 HAVING count(*) > 1) SELECT kind, id AS dropped, kept FROM u JOIN k USING (kind, key) WHERE id <> kept""",
)
def dedup_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by name and domain, patterns by title and domain, playbooks by what they rest on, in one frame of (dropped, kept)."""
    entity = load(spark, sf_dir, "customer").select(F.lit("entity").alias("kind"), F.concat(F.lower(F.regexp_replace("c_name", "[0-9]", "")), F.col("c_nationkey").cast("string")).alias("key"), F.col("c_custkey").alias("id"))
    pattern = load(spark, sf_dir, "part").select(F.lit("pattern").alias("kind"), F.concat_ws("|", F.lower(F.trim("p_name")), "p_brand").alias("key"), F.col("p_partkey").alias("id"))
    sets = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("ids"))
    playbook = sets.select(F.lit("playbook").alias("kind"), F.array_join("ids", ",").alias("key"), F.col("l_orderkey").alias("id"))
    rows = entity.unionByName(pattern).unionByName(playbook).withColumn("key", F.sha2("key", 256))
    kept = rows.groupBy("kind", "key").agg(F.min("id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(kept, ["kind", "key"]).where("id <> kept").select("kind", F.col("id").alias("dropped"), "kept")


@query(
    "g41_evaluation_replay",
    """WITH c AS (SELECT o_orderkey AS id, o_orderpriority AS slice, l_partkey AS item, round(avg(l_extendedprice) / 120000 + max(l_discount), 6) AS score, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS hit FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3),
       r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS next FROM c WINDOW w AS (PARTITION BY id ORDER BY score DESC, item)), s AS (SELECT id, slice, max(score) FILTER (WHERE rank = 1) AS top, max(score - coalesce(next, 0)) FILTER (WHERE rank = 1) AS margin, min(rank) FILTER (WHERE hit = 1) AS first_hit, max(hit) FILTER (WHERE rank = 1) AS top_hit FROM r GROUP BY 1, 2),
       a AS (SELECT *, margin < 0.02 OR top < 0.55 AS abstains FROM s)
       SELECT slice, count(*) AS cases, round(avg(abstains::INT), 6) AS abstain_rate, round(avg(CASE WHEN NOT abstains THEN top_hit END), 6) AS top1, round(avg(CASE WHEN NOT abstains THEN (coalesce(first_hit, 99) <= 3)::INT END), 6) AS recall3, round(avg(CASE WHEN NOT abstains THEN coalesce(1 / first_hit, 0) END), 6) AS mrr, round(avg(CASE WHEN NOT abstains THEN (least(top, 1) - top_hit) * (least(top, 1) - top_hit) END), 6) AS brier FROM a GROUP BY 1""",
)
def evaluation_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past cases ranked again: abstention, top-1, recall at 3, reciprocal rank and Brier score by slice."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.round(F.avg("l_extendedprice") / 120000 + F.max("l_discount"), 6).alias("score"), F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("hit"))
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("score"), "l_partkey")
    ranked = lines.select("l_orderkey", "score", "hit", F.row_number().over(w).alias("rank"), F.lead("score").over(w).alias("next"))
    first = F.col("rank") == 1
    cases = ranked.groupBy("l_orderkey").agg(F.max(F.when(first, F.col("score"))).alias("top"), F.max(F.when(first, F.col("score") - F.coalesce("next", F.lit(0.0)))).alias("margin"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_hit"), F.max(F.when(first, F.col("hit"))).alias("top_hit"))
    sliced = cases.join(load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("slice")), F.col("o_orderkey") == F.col("l_orderkey")).withColumn("abstains", (F.col("margin") < 0.02) | (F.col("top") < 0.55))
    mean = lambda c: F.round(F.avg(F.when(~F.col("abstains"), c)), 6)
    off = F.least("top", F.lit(1.0)) - F.col("top_hit")
    return sliced.groupBy("slice").agg(F.count("*").alias("cases"), F.round(F.avg(F.col("abstains").cast("int")), 6).alias("abstain_rate"), mean(F.col("top_hit")).alias("top1"), mean((F.coalesce("first_hit", F.lit(99)) <= 3).cast("int")).alias("recall3"), mean(F.coalesce(1 / F.col("first_hit"), F.lit(0.0))).alias("mrr"), mean(off * off).alias("brier"))


@query(
    "g44_coverage_report",
    """WITH s AS (SELECT l_partkey AS item, count(DISTINCT l_orderkey) AS evidence, count(*) FILTER (WHERE l_returnflag = 'R') AS failures, count(*) FILTER (WHERE l_returnflag = 'N') AS ok, max(l_shipdate) AS latest FROM lineitem GROUP BY 1), g AS (SELECT max(l_shipdate) AS now FROM lineitem),
       j AS (SELECT p_partkey, p_brand, coalesce(evidence, 0) AS evidence, coalesce(ok, 0) AS ok, coalesce(failures, 0) AS failures, latest, now FROM part LEFT JOIN s ON item = p_partkey, g)
       SELECT p_brand AS area, count(*) AS items, count(*) FILTER (WHERE evidence > 0) AS covered, count(*) FILTER (WHERE evidence >= 3 AND ok > failures) AS proven, count(*) FILTER (WHERE failures > ok) AS contested, count(*) FILTER (WHERE latest < now - INTERVAL 180 DAY) AS stale, round(count(*) FILTER (WHERE evidence > 0) / count(*), 6) AS share FROM j GROUP BY 1""",
)
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By area: what has evidence, is proven, contested, or has had none for 180 days."""
    lines = load(spark, sf_dir, "lineitem")
    s = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_orderkey").alias("evidence"), F.count_if(F.col("l_returnflag") == "R").alias("failures"), F.count_if(F.col("l_returnflag") == "N").alias("ok"), F.max("l_shipdate").alias("latest"))
    now = F.broadcast(lines.agg(F.max("l_shipdate").alias("now")))  # one row
    j = load(spark, sf_dir, "part").select("p_partkey", "p_brand").join(s, "p_partkey", "left").fillna(0, ["evidence", "failures", "ok"]).join(now)
    count = lambda c: F.count_if(c)
    return j.groupBy(F.col("p_brand").alias("area")).agg(
        F.count("*").alias("items"), count(F.col("evidence") > 0).alias("covered"), count((F.col("evidence") >= 3) & (F.col("ok") > F.col("failures"))).alias("proven"), count(F.col("failures") > F.col("ok")).alias("contested"),
        count(F.col("latest") < F.col("now") - F.expr("INTERVAL 180 DAY")).alias("stale"), F.round(count(F.col("evidence") > 0) / F.count("*"), 6).alias("share"),
    )


@query(
    "st08_late_and_undated",
    """WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 17 <> 0 THEN ts END AS ts, ts + INTERVAL 1 HOUR * (event_id % 60) AS arrived FROM events), a AS (SELECT max(arrived) - INTERVAL 1 DAY AS as_of FROM e)
       SELECT user_id, count(*) FILTER (WHERE ts IS NULL) AS undated, count(*) FILTER (WHERE arrived <= as_of) AS known, count(*) FILTER (WHERE arrived > as_of AND ts <= as_of) AS late, count(*) FILTER (WHERE ts IS NULL OR ts > as_of - INTERVAL 7 DAY) AS in_window FROM e, a GROUP BY 1""",
)
def late_and_undated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backfill as of a moment: late rows count in the window they belong to, undated ones in every window; none is dropped."""
    e = load(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 17 != 0, F.col("ts")).alias("ts"), (F.col("ts") + F.make_dt_interval(hours=F.col("event_id").cast("int") % 60)).alias("arrived"))
    as_of = F.broadcast(e.agg((F.max("arrived") - F.expr("INTERVAL 1 DAY")).alias("as_of")))  # one row
    known = F.col("arrived") <= F.col("as_of")
    return e.join(as_of).groupBy("user_id").agg(F.count_if(F.col("ts").isNull()).alias("undated"), F.count_if(known).alias("known"), F.count_if(~known & (F.col("ts") <= F.col("as_of"))).alias("late"), F.count_if(F.col("ts").isNull() | (F.col("ts") > F.col("as_of") - F.expr("INTERVAL 7 DAY"))).alias("in_window"))


@query("g07_connected_selection")
def connected_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every supplier's case the nodes that fit its budget, with the way to each; tests compare it with brute force."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_orderkey").alias("order"), F.avg("l_discount").alias("d"))
    case = F.col("l_suppkey")
    root = lines.select(case.alias("case"), F.concat(F.lit("s"), case.cast("string")).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("entity").alias("type"), F.lit(1.0).alias("score"), F.lit(80).alias("chars")).distinct()
    parts = lines.select(case.alias("case"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("node"), F.concat(F.lit("s"), case.cast("string")).alias("parent"), F.lit("pattern").alias("type"), F.round(0.72 * (1 - F.col("d")), 6).alias("score"), (60 + F.col("l_partkey") % 50).cast("int").alias("chars"))
    orders = lines.select(case.alias("case"), F.concat(F.lit("o"), F.col("order").cast("string")).alias("node"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("parent"), F.lit("playbook").alias("type"), F.round(0.5 * (1 - F.col("d")), 6).alias("score"), (90 + F.col("order") % 40).cast("int").alias("chars"))
    once = orders.groupBy("case", "node").agg(F.max_by(F.struct("parent", "type", "score", "chars"), F.struct("score", "parent")).alias("b")).select("case", "node", "b.*")
    return select_connected(root.unionByName(parts).unionByName(once.select(*root.columns)), most_nodes=40, most_chars=3000, reserved={"playbook": 3}, has_edges=True)


@query(
    "g50_remediation_by_target",
    f"""WITH a AS ({ORACLE_SQL["f50_fix_applicability"]}), e AS (SELECT l_partkey AS fix, count(*) FILTER (WHERE l_returnflag = 'N') AS ok, count(*) FILTER (WHERE l_returnflag IN ('N', 'R')) AS n FROM lineitem GROUP BY 1), k AS (SELECT l_partkey AS fix, l_suppkey AS target FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2 HAVING count(*) >= 2),
       l AS (SELECT a.fix, a.target, a.score, ok / n AS rate, n, CASE WHEN k.fix IS NOT NULL THEN 4 WHEN score >= 0.3 AND n >= 20 AND ok / n >= 0.6 THEN 1 WHEN ok / n >= 0.5 THEN 2 WHEN ok > 0 THEN 3 ELSE 4 END AS level FROM a JOIN e ON e.fix = a.fix AND n > 0 LEFT JOIN k ON k.fix = a.fix AND k.target = a.target)
       SELECT target, fix, level, score FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY level, round(rate, 9) DESC, n DESC, score DESC, fix) AS rn FROM l) WHERE rn <= 5""",
)
def remediation_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best fixes of each target: how well they did, whether they apply, and none first that failed there before."""
    lines = load(spark, sf_dir, "lineitem")
    efficacy = lines.groupBy(F.col("l_partkey").alias("fix")).agg(F.count_if(F.col("l_returnflag") == "N").alias("ok"), F.count_if(F.col("l_returnflag").isin("N", "R")).alias("n")).where("n > 0")
    failed = lines.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("fix"), F.col("l_suppkey").alias("target")).agg(F.count("*").alias("failures")).where("failures >= 2")
    known = fix_applicability(spark, sf_dir).join(efficacy, "fix").join(failed, ["fix", "target"], "left").withColumn("rate", F.col("ok") / F.col("n"))
    level = F.when(F.col("failures").isNotNull(), 4).when((F.col("score") >= 0.3) & (F.col("n") >= 20) & (F.col("rate") >= 0.6), 1).when(F.col("rate") >= 0.5, 2).when(F.col("ok") > 0, 3).otherwise(4)
    w = Window.partitionBy("target").orderBy("level", F.desc(F.round("rate", 9)), F.desc("n"), F.desc("score"), "fix")
    return known.withColumn("level", level).withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("target", "fix", "level", "score")


@query(
    "g09_edge_reconcile",
    """WITH w AS (SELECT 'order_part' AS edge_type, l_orderkey AS src, l_partkey AS dst FROM lineitem UNION SELECT 'customer_order', o_custkey, o_orderkey FROM orders), s AS (SELECT edge_type, src, dst + CASE WHEN dst % 10 = 3 THEN 10000000 ELSE 0 END AS dst FROM w WHERE src % 7 <> 0)
       SELECT coalesce(w.edge_type, s.edge_type) AS edge_type, CASE WHEN s.src IS NULL THEN 'open' WHEN w.src IS NULL THEN 'close' ELSE 'keep' END AS action, count(*) AS n FROM w FULL JOIN s ON s.edge_type = w.edge_type AND s.src = w.src AND s.dst = w.dst GROUP BY 1, 2""",
)
def edge_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges made from the relational rows against those stored (a part of them, some to wrong ends): what opens, closes and stays."""
    edge = lambda name, kind, a, b: load(spark, sf_dir, name).select(F.lit(kind).alias("edge_type"), F.col(a).alias("src"), F.col(b).alias("dst")).distinct()
    wanted = edge("lineitem", "order_part", "l_orderkey", "l_partkey").unionByName(edge("orders", "customer_order", "o_custkey", "o_orderkey"))
    stored = wanted.where("src % 7 <> 0").withColumn("dst", F.col("dst") + F.when(F.col("dst") % 10 == 3, 10_000_000).otherwise(0))
    both = wanted.withColumn("w", F.lit(True)).join(stored.withColumn("s", F.lit(True)), ["edge_type", "src", "dst"], "full")
    return both.groupBy("edge_type", F.when(F.col("s").isNull(), "open").when(F.col("w").isNull(), "close").otherwise("keep").alias("action")).agg(F.count("*").alias("n"))


_USAGE = """'{"model": "m' || event_id % 3 || '", "usage": {"prompt_tokens": ' || user_id * 10 || ', "completion_tokens": ' || (20 + user_id % 50) || CASE event_id % 4 WHEN 0 THEN ', "completion_tokens_details": {"reasoning_tokens": ' || (user_id % 90) || '}' WHEN 1 THEN ', "completion_tokens_details": null' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN ', "prompt_tokens_details": {"cached_tokens": ' || user_id * 4 || '}' ELSE '' END || '}}'"""


@query(
    "g65_usage_fields",
    f"""WITH j AS (SELECT event_id, {_USAGE} AS j FROM events), x AS (SELECT event_id, json_extract_string(j, '$.model') AS model, CAST(json_extract(j, '$.usage.prompt_tokens') AS BIGINT) AS prompt, CAST(json_extract(j, '$.usage.completion_tokens') AS BIGINT) AS completion, coalesce(TRY_CAST(json_extract_string(j, '$.usage.completion_tokens_details.reasoning_tokens') AS BIGINT), 0) AS reasoning, coalesce(TRY_CAST(json_extract_string(j, '$.usage.prompt_tokens_details.cached_tokens') AS BIGINT), 0) AS cached FROM j)
       SELECT event_id, model, prompt, completion, least(reasoning, completion) AS reasoning, least(cached, prompt) AS cached, completion - least(reasoning, completion) AS visible FROM x""",
)
def usage_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every response; reasoning is part of the completion and cached part of the prompt, missing details are 0."""
    j = load(spark, sf_dir, "events").select("event_id", F.expr(_USAGE).alias("j"))
    number = lambda path: F.coalesce(F.get_json_object("j", path).try_cast("bigint"), F.lit(0))
    prompt, completion = number("$.usage.prompt_tokens"), number("$.usage.completion_tokens")
    reasoning, cached = F.least(number("$.usage.completion_tokens_details.reasoning_tokens"), completion), F.least(number("$.usage.prompt_tokens_details.cached_tokens"), prompt)
    return j.select("event_id", F.get_json_object("j", "$.model").alias("model"), prompt.alias("prompt"), completion.alias("completion"), reasoning.alias("reasoning"), cached.alias("cached"), (completion - reasoning).alias("visible"))


@query(
    "g33_issue_recurrence",
    """WITH s AS (SELECT event_id, user_id, ts, event_type || '|' || CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS signature FROM events WHERE event_type IN ('error', 'signup')),
       p AS (SELECT *, lag(event_id) OVER w AS prior, lag(ts) OVER w AS prior_ts, row_number() OVER w AS nth FROM s WINDOW w AS (PARTITION BY signature ORDER BY ts, event_id))
       SELECT event_id, signature, CASE WHEN ts - prior_ts <= INTERVAL 1 DAY THEN prior END AS recurs, nth FROM p""",
)
def issue_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case under the signature of its issue, with the most recent one of that signature within a day and its number."""
    signature = F.concat_ws("|", "event_type", (F.get_json_object("props", "$.k").cast("long") % 20).cast("string"))
    cases = load(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup")).select("event_id", "ts", signature.alias("signature"))
    w = Window.partitionBy("signature").orderBy("ts", "event_id")
    near = F.col("ts") <= F.lag("ts").over(w) + F.expr("INTERVAL 1 DAY")
    return cases.select("event_id", "signature", F.when(near, F.lag("event_id").over(w)).alias("recurs"), F.row_number().over(w).alias("nth"))


@query(
    "g42_extraction_stability",
    """WITH r AS (SELECT l_orderkey AS id, l_partkey AS claim, l_linenumber % 3 AS run FROM lineitem), c AS (SELECT id, claim, count(DISTINCT run) AS runs FROM r GROUP BY 1, 2), n AS (SELECT id, count(DISTINCT run) AS of_runs FROM r GROUP BY 1), p AS (SELECT p_partkey, p_size < 10 AS forbidden FROM part)
       SELECT CAST(of_runs AS BIGINT) AS of_runs, count(DISTINCT id) AS cases, count(*) AS claims, round(avg((runs = of_runs)::INT), 6) AS stable, round(avg(forbidden::INT), 6) AS violations FROM c JOIN n USING (id) JOIN p ON p_partkey = claim GROUP BY 1""",
)
def extraction_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over repeated runs of an extraction: the share of claims that every run makes, and of those that break a rule."""
    r = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("claim"), (F.col("l_linenumber") % 3).alias("run")).distinct()
    runs = r.groupBy("id").agg(F.countDistinct("run").alias("of_runs"))
    claims = r.groupBy("id", "claim").agg(F.count("*").alias("runs")).join(runs, "id").join(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("claim"), (F.col("p_size") < 10).alias("forbidden")), "claim")
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return claims.groupBy("of_runs").agg(F.countDistinct("id").alias("cases"), F.count("*").alias("claims"), share(F.col("runs") == F.col("of_runs")).alias("stable"), share(F.col("forbidden")).alias("violations"))
