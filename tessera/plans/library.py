"""Files, versions, page structure, chunks by kind and error lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import chunks as C
from tessera.functions import library as L
from tessera.functions import messages as M
from tessera.functions import text as T
from tessera.plans.mail import mail
from tessera.plans.registry import load, query
from tessera.plans.texts import _duck_normalise


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# -- file names ------------------------------------------------------------------

#: Every document under a file name of a common shape.
_FILE = "CASE doc_id % 6 WHEN 5 THEN 'Copy of ' ELSE '' END || 'VPN SOP ' || CAST(floor(doc_id / 7) AS BIGINT) || CASE doc_id % 6 WHEN 0 THEN ' v2' WHEN 1 THEN '_rev3.1' WHEN 2 THEN ' (2)' WHEN 3 THEN ' Final' WHEN 4 THEN ' Draft v' || (doc_id % 4) || '.' || (doc_id % 3) ELSE '' END || CASE doc_id % 2 WHEN 0 THEN '.docx' ELSE '.PDF' END"
_FOLDER = "CASE WHEN doc_id % 7 = 3 THEN 'Old' WHEN doc_id % 11 = 2 THEN 'Current' ELSE '' END"
_FILES = f"files AS (SELECT doc_id, {_FILE} AS name, {_FOLDER} AS folder FROM documents)"
_STEM = r"regexp_replace(trim(name), '(?i)\.[a-z0-9]{1,5}$', '')"
# The other engine has no look-behind: the character before the mark is captured and put back.
_MARK = r"(?i)(^|[^a-z0-9]){0}[\s._-]*(\d+(?:\.\d+)*)\b"
_V, _R = _MARK.format("v(?:er(?:sion)?)?"), _MARK.format("rev(?:ision)?")
_FAMILY = f"array_to_string(list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace({_STEM}, '{_V}', '\\1 ', 'g'), '{_R}', '\\1 ', 'g'), '\\(\\s*\\d+\\s*\\)\\s*$', ' ')), '[a-z0-9]+'), lambda w: w NOT IN ({', '.join(map(_q, L.NOISE_WORDS))})), ' ')"
_VERSION = f"list_transform(string_split(coalesce(nullif(regexp_extract({_STEM}, '{_V}', 2), ''), nullif(regexp_extract({_STEM}, '{_R}', 2), ''), nullif(regexp_extract({_STEM}, '\\(\\s*(\\d+)\\s*\\)\\s*$', 1), '')), '.'), lambda p: CAST(p AS INT))"
_RANK = " + ".join(f"CASE WHEN regexp_matches(lower(folder || ' ' || name), '\\b{w}\\b') THEN {r} ELSE 0 END" for w, r in L.QUALIFIER_RANK.items())


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = load(spark, sf_dir, "documents").select("doc_id", F.expr(_FILE).alias("name"), F.expr(_FOLDER).alias("folder"))
    return named.select("doc_id", L.family(F.col("name")).alias("family"), L.version(F.col("name")).alias("version"), L.qualifier_rank(F.col("name"), F.col("folder")).alias("rank"))


@query("f26_document_identity", f"WITH {_FILES} SELECT doc_id, {_FAMILY} AS family, array_to_string({_VERSION}, '.') AS version, {_RANK} AS rank FROM files")
def document_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family, version and rank of revision words of every file."""
    return files(spark, sf_dir).select("doc_id", "family", F.array_join(F.col("version").cast("array<string>"), ".").alias("version"), "rank")


@query(
    "g34_version_families",
    f"""WITH {_FILES}, i AS (SELECT doc_id, {_FAMILY} AS family, {_VERSION} AS version, {_RANK} AS rank FROM files),
       f AS (SELECT *, max(version) OVER w AS best, max(rank) OVER w AS top, count(version) OVER w AS versioned, count(*) OVER w AS members FROM i WHERE family <> '' WINDOW w AS (PARTITION BY family)),
       g AS (SELECT family, members, versioned, count(*) FILTER (WHERE version = best) AS nb, min(doc_id) FILTER (WHERE version = best) AS b, count(*) FILTER (WHERE rank = top) AS nt, min(doc_id) FILTER (WHERE rank = top) AS t FROM f WHERE members > 1 GROUP BY 1, 2, 3)
       SELECT family, members, CASE WHEN nb = 1 THEN b WHEN nt = 1 THEN t END AS primary_id, NOT (nb = 1 AND versioned = members) AS needs_review FROM g""",
)
def version_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of a family that counts: the one of the highest version, else the one of the highest rank, else none."""
    named = files(spark, sf_dir).where("family <> ''")
    top = lambda key: named.groupBy("family", key).agg(F.count("*").alias("n"), F.min("doc_id").alias("id")).where(F.col(key).isNotNull()).groupBy("family").agg(F.max_by(F.struct("n", "id"), F.col(key)).alias(f"top_{key}"))
    size = named.groupBy("family").agg(F.count("*").alias("members"), F.count("version").alias("versioned")).where("members > 1")
    all_ = size.join(top("version"), "family", "left").join(top("rank"), "family", "left")
    clear = F.coalesce(F.col("top_version.n") == 1, F.lit(False))
    chosen = F.when(clear, F.col("top_version.id")).when(F.col("top_rank.n") == 1, F.col("top_rank.id"))
    return all_.select("family", "members", chosen.alias("primary_id"), (~(clear & (F.col("versioned") == F.col("members")))).alias("needs_review"))


@query(
    "g36_family_supersession",
    f"""WITH {_FILES}, i AS (SELECT doc_id, {_FAMILY} AS family, {_VERSION} AS version FROM files), v AS (SELECT family, version, min(doc_id) AS newest FROM i WHERE version IS NOT NULL AND family <> '' GROUP BY 1, 2), n AS (SELECT *, lead(newest) OVER (PARTITION BY family ORDER BY version) AS by_id FROM v)
       SELECT i.doc_id AS older, n.by_id AS newer FROM i JOIN n ON i.family = n.family AND i.version = n.version WHERE by_id IS NOT NULL""",
)
def family_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document of a version with the first document of its family's next version."""
    named = files(spark, sf_dir).where("family <> '' AND version IS NOT NULL")
    by_version = named.groupBy("family", "version").agg(F.min("doc_id").alias("first"))
    following = by_version.withColumn("newer", F.lead("first").over(Window.partitionBy("family").orderBy("version"))).where("newer IS NOT NULL")
    return named.join(following, ["family", "version"]).select(F.col("doc_id").alias("older"), "newer")


#: An article's version and a target's, from the keys of each line.
_ARTICLE = "CASE l_linenumber % 5 WHEN 0 THEN (l_partkey % 9) || '.x' WHEN 1 THEN 'v' || (l_partkey % 9) || '.' || (l_suppkey % 5) WHEN 2 THEN (l_partkey % 9) || '*' WHEN 3 THEN 'abc' ELSE (l_partkey % 3) || '.' || (l_suppkey % 7) || '.' || (l_orderkey % 4) END"
_TARGET = "CASE l_orderkey % 13 WHEN 0 THEN 'n/a' ELSE (l_orderkey % 3) || '.' || (l_linenumber % 5) || '.' || (l_partkey % 3) END"
_VPART = r"regexp_extract(trim({0}), '^[vV]?(\d+)(?:\.(\d+))?(?:\.(\d+))?(\*|\.\*|\.[xX])?$', {1})"


def _duck_version(v: str) -> str:
    return "[" + ", ".join(f"coalesce(CAST(nullif({_VPART.format(v, k)}, '') AS INT), 0)" for k in (1, 2, 3)) + "]"


@query(
    "f27_version_compatible",
    f"""WITH v AS (SELECT l_orderkey, l_linenumber, {_ARTICLE} AS a, {_TARGET} AS t FROM lineitem)
       SELECT l_orderkey, l_linenumber, CASE WHEN {_VPART.format('a', 1)} = '' OR {_VPART.format('t', 1)} = '' THEN NULL WHEN {_VPART.format('a', 1)} <> {_VPART.format('t', 1)} THEN false
         WHEN {_VPART.format('a', 4)} <> '' OR {_VPART.format('a', 2)} = '' OR {_VPART.format('t', 4)} <> '' OR {_VPART.format('t', 2)} = '' THEN true ELSE {_duck_version('a')} <= {_duck_version('t')} END AS ok FROM v""",
)
def version_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.version_compatible(F.expr(_ARTICLE), F.expr(_TARGET)).alias("ok"))


# -- pages as elements, text and sections ----------------------------------------

_TEXT = r"trim(regexp_replace(regexp_replace(b, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
_ELEMENTS = f"""blocks AS (SELECT page_id, unnest(x) AS b, generate_subscripts(x, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, {_q(L.BLOCK)}) AS x FROM pages)),
 els AS (SELECT page_id, i, lower(regexp_extract(b, '^<(\\w+)', 1)) AS tag, {_TEXT} AS text FROM blocks WHERE {_TEXT} <> ''),
 elements AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS pos, CASE WHEN tag LIKE 'h_' THEN 'heading' WHEN tag = 'li' THEN 'list_item' WHEN tag = 'tr' THEN 'table' WHEN tag = 'pre' THEN 'code' ELSE 'paragraph' END AS kind, CASE WHEN tag LIKE 'h_' THEN CAST(tag[2] AS INT) END AS level, text FROM els)"""
_LINE = "CASE kind WHEN 'heading' THEN chr(10) || repeat('#', level) || ' ' || text || chr(10) WHEN 'list_item' THEN '- ' || text WHEN 'table' THEN chr(10) || text || chr(10) ELSE text END"


@query("u08_element_rendering", f"WITH {_ELEMENTS} SELECT page_id, regexp_replace(regexp_replace(string_agg({_LINE}, chr(10) ORDER BY pos), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+\\z', '', 'g') AS text FROM elements GROUP BY 1")
def element_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page that has an element."""
    items = load(spark, sf_dir, "pages").select("page_id", L.elements(F.col("html")).alias("e")).where(F.size("e") > 0)
    return items.select("page_id", L.rendered(F.col("e")).alias("text"))


@query(
    "u02_section_paths",
    f"""WITH RECURSIVE {_ELEMENTS}, r(page_id, pos, kind, text, path) AS (SELECT page_id, CAST(0 AS BIGINT), '', '', CAST([] AS VARCHAR[]) FROM pages
        UNION ALL SELECT e.page_id, e.pos, e.kind, e.text, CASE WHEN e.kind = 'heading' THEN list_append(r.path[1:e.level - 1], e.text) ELSE r.path END FROM r JOIN elements e ON e.page_id = r.page_id AND e.pos = r.pos + 1)
       SELECT page_id, pos, kind, array_to_string(path, ' > ') AS path, length(text) AS chars FROM r WHERE pos > 0""",
)
def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element with the headings above it."""
    items = load(spark, sf_dir, "pages").select("page_id", F.posexplode(L.with_paths(L.elements(F.col("html")))).alias("p", "e"))
    return items.select("page_id", (F.col("p") + 1).cast("long").alias("pos"), "e.kind", "e.path", F.length("e.text").cast("long").alias("chars"))


@query(
    "u06_structured_chunks",
    f"""WITH RECURSIVE {_ELEMENTS}, r(page_id, pos, kind, text, path) AS (SELECT page_id, CAST(0 AS BIGINT), '', '', CAST([] AS VARCHAR[]) FROM pages
        UNION ALL SELECT e.page_id, e.pos, e.kind, e.text, CASE WHEN e.kind = 'heading' THEN list_append(r.path[1:e.level - 1], e.text) ELSE r.path END FROM r JOIN elements e ON e.page_id = r.page_id AND e.pos = r.pos + 1),
       k AS (SELECT page_id, pos, array_to_string(path, ' > ') AS path, text, CASE WHEN kind IN ('table', 'code') THEN kind WHEN regexp_matches(text, '(?i)^(warning|caution|achtung|attention)\\b') THEN 'warning' WHEN kind = 'list_item' THEN 'step' ELSE 'section' END AS kind FROM r WHERE pos > 0 AND kind <> 'heading'),
       g AS (SELECT *, CASE WHEN kind IN ('section', 'step') AND kind = lag(kind) OVER w AND path = lag(path) OVER w THEN 0 ELSE 1 END AS fresh FROM k WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
       c AS (SELECT *, sum(fresh) OVER (PARTITION BY page_id ORDER BY pos) AS chunk FROM g)
       SELECT page_id, CAST(chunk AS BIGINT) AS chunk, min(kind) AS kind, min(path) AS path, count(*) AS elements, string_agg(text, chr(10) ORDER BY pos) AS text FROM c GROUP BY 1, 2""",
)
def structured_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that keep to a section: its paragraphs together, its steps together, each table, code block and warning alone."""
    items = load(spark, sf_dir, "pages").select("page_id", F.posexplode(L.with_paths(L.elements(F.col("html")))).alias("pos", "e")).select("page_id", "pos", "e.*").where("kind <> 'heading'")
    kind = F.when(F.col("kind").isin("table", "code"), F.col("kind")).when(F.col("text").rlike(r"(?i)^(warning|caution|achtung|attention)\b"), "warning").when(F.col("kind") == "list_item", "step").otherwise("section")
    w = Window.partitionBy("page_id").orderBy("pos")
    typed = items.withColumn("kind", kind)
    goes_on = F.col("kind").isin("section", "step") & (F.col("kind") == F.lag("kind").over(w)) & (F.col("path") == F.lag("path").over(w))
    numbered = typed.withColumn("fresh", F.when(goes_on, 0).otherwise(1)).withColumn("chunk", F.sum("fresh").over(w))
    parts = numbered.groupBy("page_id", "chunk").agg(F.first("kind").alias("kind"), F.first("path").alias("path"), F.count("*").alias("elements"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return parts.select("page_id", "chunk", "kind", "path", "elements", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


# -- chunks by kind of source ----------------------------------------------------


@query("u04_thread_chunks")
def thread_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message without its quoted part, in chunks with author and the start of what it replies to; tests compare it."""
    body = F.col("body")
    fresh = mail(spark, sf_dir).select("conv_id", "turn", F.col("sender").alias("author"), F.left(M.strip(F.regexp_extract(body, M.CUT, 0)), F.lit(200)).alias("replies_to"), M.fresh_text(body).alias("text"))
    spans = fresh.select("*", F.posexplode(C.chunk_spans(F.col("text"))).alias("pos", "s"))
    return spans.select("conv_id", "turn", "pos", F.lit("message").alias("kind"), "author", "replies_to", F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("chunk"))


@query("u05_ticket_chunks", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'comment' ELSE 'body' END AS kind, 'Order ' || o_orderkey || ' of ' || o_custkey || ' in state ' || o_orderstatus AS chunk, 'priority=' || o_orderpriority || ';status=' || o_orderstatus || ';key=' || o_orderkey || ';author=' || coalesce(CASE WHEN o_custkey % 4 > 0 THEN 'C' || o_custkey END, 'R' || o_orderkey % 7) AS facts FROM orders")
def ticket_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticket bodies and comments with the facts a ranker uses; empty facts are left out, the assignee is the author before the reporter."""
    assignee, reporter = F.when(F.col("o_custkey") % 4 > 0, F.concat(F.lit("C"), F.col("o_custkey").cast("string"))), F.concat(F.lit("R"), (F.col("o_orderkey") % 7).cast("string"))
    body = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" of "), F.col("o_custkey").cast("string"), F.lit(" in state "), F.col("o_orderstatus"))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.coalesce(assignee, reporter).alias("author"), body.alias("body"), F.explode(C.chunk_spans(body)).alias("s"))
    facts = F.array_join(F.filter(F.array(*(F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"{k}="), F.col(c).cast("string"))) for k, c in (("priority", "o_orderpriority"), ("status", "o_orderstatus"), ("key", "o_orderkey"), ("author", "author")))), lambda x: x.isNotNull()), ";")
    return rows.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "comment").otherwise("body").alias("kind"), F.substring("body", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("chunk"), facts.alias("facts"))


@query("u03_jsonl_windows", "WITH l AS (SELECT user_id, props, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS n, CAST(ts AS DATE) AS day FROM events) SELECT user_id, day, n // 40 AS window_no, count(*) AS lines, string_agg(props, chr(10) ORDER BY n) AS text FROM l GROUP BY 1, 2, 3")
def jsonl_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of a user's day in windows of 40 whole lines."""
    day = F.to_date("ts")
    n = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id")) - 1
    lines = load(spark, sf_dir, "events").select("user_id", "event_id", "ts", "props", day.alias("day")).withColumn("n", n).withColumn("window_no", F.expr("n div 40"))
    w = lines.groupBy("user_id", "day", "window_no").agg(F.count("*").alias("lines"), F.array_sort(F.collect_list(F.struct("n", "props"))).alias("t"))
    return w.select("user_id", "day", "window_no", "lines", F.array_join(F.transform("t", lambda x: x["props"]), "\n").alias("text"))


# -- error lines -----------------------------------------------------------------

#: A log line for every event.
_LOG = """CASE event_id % 9 WHEN 0 THEN '  2024-01-02 10:22:01 ERROR com.foo.Bar: java.lang.NullPointerException: value at /opt/app/lib/x' || user_id || '.jar was null' WHEN 1 THEN 'ORA-' || (12000 + user_id % 40) || ': TNS could not resolve the connect identifier for host 10.1.2.' || (user_id % 200) || ':1521'
 WHEN 2 THEN 'HTTP 50' || (user_id % 4) || ' Service Unavailable after ' || (1000 + event_id) || ' ms' WHEN 3 THEN 'exit errno=' || (10 + user_id % 5) || ' permission denied' WHEN 4 THEN 'all good today' WHEN 5 THEN 'FATAL: disk full on ''node-' || user_id || ''''
 WHEN 6 THEN 'SQLSTATE[HY000] general error' WHEN 7 THEN 'driver returned 0x8007' || (1000 + user_id) || ' while loading' ELSE 'x ERROR y' END"""
_KIND = f"""CASE WHEN regexp_extract(line, '{T.EXCEPTION}', 1) <> '' THEN regexp_extract(line, '{T.EXCEPTION}', 1)
 WHEN regexp_extract(line, '{T.VENDOR_CODE}', 1) <> '' THEN CASE WHEN upper(regexp_extract(line, '{T.VENDOR_CODE}', 1)) LIKE 'ORA-%' THEN replace(regexp_extract(line, '{T.VENDOR_CODE}', 1), '-', '_')
      WHEN upper(regexp_extract(line, '{T.VENDOR_CODE}', 1)) LIKE 'SQLSTATE%' THEN 'SQLSTATE' WHEN upper(regexp_extract(line, '{T.VENDOR_CODE}', 1)) LIKE '0X%' THEN 'HEX_CODE' ELSE 'ERRNO_' || regexp_extract(regexp_extract(line, '{T.VENDOR_CODE}', 1), '\\d+') END
 WHEN regexp_extract(line, '{T.HTTP_5XX}', 1) <> '' THEN 'HTTP_' || regexp_extract(line, '{T.HTTP_5XX}', 1) WHEN regexp_matches(line, '{T.LOG_LEVEL}') THEN 'LOG_ERROR' END"""
_LINES = f"lines AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, trim({_LOG}) AS line, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS pos FROM events), typed AS (SELECT *, CASE WHEN length(line) >= 12 THEN {_KIND} END AS kind FROM lines)"
_SIGNATURE = f"""trim(left(regexp_replace(array_to_string(list_concat([upper(kind)], list_transform(list_filter(regexp_extract_all(lower({_duck_normalise('line')}), '[a-z0-9<>._]+'), lambda t: t NOT IN ({', '.join(map(_q, T.ERROR_STOPWORDS))}) AND NOT starts_with(t, '<') AND length(t) > 1
 AND NOT regexp_matches(t, '^\\d+$') AND t <> lower(kind) AND NOT ends_with(t, '.' || lower(kind)))[1:6], lambda t: upper(t))), '_'), '[^A-Z0-9_]', '_', 'g'), 120), '_')"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, user_id, day, pos, line, kind``: a user's day is one log; lines under 12 characters have no kind."""
    pos = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    lines = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.to_date("ts").alias("day"), F.trim(F.expr(_LOG)).alias("line")).withColumn("pos", pos)
    return lines.select("event_id", "user_id", "day", "pos", "line", F.when(F.length("line") >= T.LEAST_ERROR_LINE, T.error_type(F.col("line"))).alias("kind"))


@query("f16_error_classify", f"WITH {_LINES} SELECT event_id, kind FROM typed")
def error_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines(spark, sf_dir).select("event_id", "kind")


@query("f17_signature_key", f"WITH {_LINES} SELECT event_id, {_SIGNATURE} AS signature FROM typed WHERE kind IS NOT NULL")
def signature_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines(spark, sf_dir).where("kind IS NOT NULL").select("event_id", T.signature_key(F.col("kind"), T.normalize_error_line(F.col("line"))).alias("signature"))


@query(
    "f18_log_fingerprints",
    f"""WITH {_LINES}, c AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY user_id, day ORDER BY pos) - 1 AS upto FROM typed), s AS (SELECT user_id, day, {_SIGNATURE} AS signature, min(pos) AS pos FROM c WHERE kind IS NOT NULL AND pos <= 500 AND upto <= 40000 GROUP BY 1, 2, 3)
       SELECT user_id, day, signature, pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY pos) AS rn FROM s) WHERE rn <= 3""",
)
def log_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three signatures of a log's first 500 lines and 40,000 characters, the rule's own bounds."""
    upto = F.sum(F.length("line") + 1).over(Window.partitionBy("user_id", "day").orderBy("pos")) - 1
    lines = log_lines(spark, sf_dir).withColumn("upto", upto).where("pos <= 500 AND upto <= 40000 AND kind IS NOT NULL")
    first = lines.groupBy("user_id", "day", T.signature_key(F.col("kind"), T.normalize_error_line(F.col("line"))).alias("signature")).agg(F.min("pos").alias("pos"))
    return first.withColumn("rn", F.row_number().over(Window.partitionBy("user_id", "day").orderBy("pos"))).where("rn <= 3").drop("rn")
