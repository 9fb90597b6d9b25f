"""Structured chunks of every document, and of every record by the chunker of its kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import sections as S
from tessera.operators.chunking import dispatched_chunks, document_chunks
from tessera.plans.registry import load, query


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: Fixed expressions of both engines: each line of a text is an element, in turns of twelve; two headings open a turn.
_SECOND = "CASE WHEN doc_id % 2 = 0 THEN 'Steps' ELSE 'Part' END"
_KIND = "CASE pos % 12 WHEN 0 THEN 'heading' WHEN 1 THEN 'heading' WHEN 7 THEN 'table' WHEN 8 THEN 'figure' ELSE 'paragraph' END"
_LINE = f"CASE pos % 12 WHEN 0 THEN 'Case ' || line WHEN 1 THEN {_SECOND} WHEN 4 THEN pos || '. ' || line WHEN 5 THEN pos || '. ' || line WHEN 6 THEN 'Warning: ' || line WHEN 9 THEN 'value = ' || line WHEN 10 THEN 'value = ' || line ELSE line END"
_SECTION = f"CASE WHEN pos % 12 = 0 THEN array(trim('Case ' || top)) ELSE array(trim('Case ' || top), {_SECOND}) END"


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with ``elements``: the lines of a text, those of each dozen under two headings."""
    item = lambda line, pos: F.struct(line.alias("line"), pos.cast("bigint").alias("pos"))
    lines = load(spark, sf_dir, "documents").withColumn("l", F.transform(F.split("text", "\n"), item))
    made = f"transform(l, x -> named_struct('kind', {_KIND}, 'text', trim({_LINE}), 'section', {_SECTION}))".replace("pos", "x.pos").replace("line", "x.line").replace("top", "l[cast(x.pos - x.pos % 12 AS INT)].line")
    return lines.select("doc_id", "text", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.expr(made).alias("elements"))


_STEP = f"regexp_matches(text, {_q(S.STEP)}) AND (regexp_matches(text, {_q(S.SPELT_STEP)}) OR regexp_matches(array_to_string(section, ' '), {_q(S.PROCEDURE)}))"
_ALONE = f"(e.kind = 'table' AND length(e.text) >= {S.TABLE_ALONE})"
_FRESH = f"(NOT r.open OR e.kind = 'heading' OR {_ALONE} OR (e.plain AND e.step AND r.step))"
_CHARS = f"(length(e.text) + CASE WHEN {_FRESH} THEN 0 ELSE r.chars END)"


@query(
    "u06_document_chunks",
    f"""WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), p AS (SELECT doc_id, ls, unnest(range(0, len(ls))) AS pos FROM l), q AS (SELECT doc_id, pos, ls[pos + 1] AS line, ls[pos - pos % 12 + 1] AS top FROM p),
        i AS (SELECT doc_id, pos, {_KIND} AS kind, trim({_LINE}) AS text, {_SECTION.replace("array(", "list_value(")} AS section FROM q),
        e AS (SELECT *, kind = 'paragraph' AS plain, {_STEP} AS step, regexp_matches(text, {_q(S.WARNING)}) AS warning FROM i),
        r AS (SELECT doc_id, CAST(-1 AS BIGINT) AS pos, 0 AS part, CAST(0 AS BIGINT) AS chars, false AS step, false AS open FROM documents WHERE text IS NOT NULL
            UNION ALL SELECT e.doc_id, e.pos, r.part + CASE WHEN {_FRESH} THEN 1 ELSE 0 END, {_CHARS}, (e.plain AND e.step) OR (NOT {_FRESH} AND r.step), NOT ({_ALONE} OR (e.plain AND NOT e.warning AND {_CHARS} >= {S.TARGET_CHARS})) FROM r JOIN e ON e.doc_id = r.doc_id AND e.pos = r.pos + 1),
        c AS (SELECT doc_id, part, min_by(section, pos) AS section, count(*) AS elements, string_agg(text, chr(10) ORDER BY pos) FILTER (WHERE text <> '') AS text, bool_or(regexp_matches(text, {_q(S.STEP)})) AS numbered, bool_or(regexp_matches(text, {_q(S.STEP)}) AND regexp_matches(text, {_q(S.SPELT_STEP)})) AS spelt,
            bool_or(warning) AS warns, bool_and(kind = 'table') AS tables, bool_and(kind = 'figure') AS figures, sum(CASE WHEN text <> '' THEN 1 ELSE 0 END) AS lines, sum(CASE WHEN regexp_matches(text, {_q(S.CODE_LINE)}) THEN 1 ELSE 0 END) AS code FROM r JOIN e USING (doc_id, pos) GROUP BY 1, 2),
        k AS (SELECT *, array_to_string(section, ' > ') AS path, CASE WHEN spelt OR (numbered AND regexp_matches(array_to_string(section, ' '), {_q(S.PROCEDURE)})) THEN 'procedure_step' WHEN warns THEN 'warning' WHEN tables THEN 'table' WHEN figures THEN 'figure' WHEN lines >= 2 AND code >= 0.6 * lines THEN 'code_block' ELSE 'heading_section' END AS kind FROM c WHERE text IS NOT NULL),
        b AS (SELECT *, NOT contains(text, chr(10)) AND suffix(path, text) AS bare FROM k), n AS (SELECT *, coalesce(sum(CASE WHEN bare THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM b)
        SELECT doc_id, CAST(chunk AS INT) AS chunk, max_by(kind, part) AS kind, max_by(path, part) AS section, CAST(sum(elements) AS BIGINT) AS elements, CASE WHEN chunk = 0 THEN 'Document ' || doc_id || chr(10) || chr(10) ELSE '' END || string_agg(text, chr(10) ORDER BY part) AS text FROM n GROUP BY doc_id, n.chunk HAVING NOT bool_and(bare)""",
)
def structured_document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step, warning, table or section a chunk, closed at 1,500 characters."""
    return document_chunks(elements(spark, sf_dir), "doc_id")


@query("u07_dispatched_chunks")
def dispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document, each by the chunker of the source and type it is given by its number; tests compare it."""
    source = F.expr("CASE doc_id % 5 WHEN 0 THEN 'servicenow' WHEN 1 THEN 'gmail' WHEN 2 THEN 'zoho_desk' WHEN 3 THEN 'local_file' END")
    kind = F.expr("CASE doc_id % 3 WHEN 0 THEN 'kb_article' WHEN 1 THEN 'attachment' ELSE 'message' END")
    records = elements(spark, sf_dir).select("doc_id", "title", F.col("text").alias("body"), F.when(F.col("doc_id") % 2 == 0, F.col("elements")).alias("elements"), source.alias("source_type"), kind.alias("evidence_type"))
    return dispatched_chunks(records, "doc_id")
