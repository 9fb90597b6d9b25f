"""Attachments: text of call transcripts, nested event records, logs and notes, and text to embed from nested records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.artifacts import artifact_texts, json_strings
from tessera.plans.registry import load, query

#: Fixed value: most characters of the strings of a nested record.
MOST_STRINGS = 1_200

#: Fixed expressions of both engines: every turn as a transcript with a repeated line, every event as a nested record (one of ten cut short), every document as a log, a note or a file no parser takes.
_TRANSCRIPT = r"concat('WEBVTT', chr(13), chr(10), chr(10), '1', chr(10), '00:01.000 --> 00:02.000', chr(10), '<v ', coalesce(role, ''), '>', coalesce(text, ''), '</v>', chr(10), chr(10), CAST(turn AS VARCHAR(20)), chr(10), '00:02.000 --> 00:03.000', chr(10), ' Noted. ', chr(10), 'Noted.', chr(10))"
_RECORD = """concat('{"event":{"id":', CAST(event_id AS VARCHAR(20)), ',"z":[true,null,{"type":" ', coalesce(event_type, ''), ' ","deep":[[false,[', CAST(event_id % 7 AS VARCHAR(20)), ',"a"]],{}]}],"props":', coalesce(props, 'null'), '},"none":[],"blank":" "', CASE WHEN event_id % 10 = 7 THEN '' ELSE '}' END)"""
_FILES = {
    "conversations": ("concat('call-', CAST(conv_id AS VARCHAR(20)), '-', CAST(turn AS VARCHAR(20)), '.VTT')", "CAST(NULL AS VARCHAR(40))", _TRANSCRIPT),
    "events": ("concat('event-', CAST(event_id AS VARCHAR(20)))", "'application/json; charset=utf-8'", _RECORD),
    "documents": ("concat('doc-', CAST(doc_id AS VARCHAR(20)), CASE doc_id % 3 WHEN 0 THEN '.log' WHEN 1 THEN '.md' ELSE '.bin' END)", "'application/octet-stream'", "coalesce(text, '')"),
}


def _trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


#: Every leaf of a record in the order of the text: its path, and its value as text.
_LEAVES = """SELECT {key}, j.id AS place, regexp_replace(j.fullkey, '^\\$\\.?', '') AS path, j.type AS type,
    CASE j.type WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN CASE j.atom::VARCHAR WHEN 'true' THEN 'True' ELSE 'False' END ELSE json_extract_string(j.atom, '$') END AS shown
    FROM {table}, json_tree({json}) j WHERE j.type NOT IN ('OBJECT', 'ARRAY')"""


@query(
    "sc12_artifact_text",
    rf"""WITH f AS ({" UNION ALL ".join(f"SELECT {n} AS filename, {m} AS mime, {c} AS content FROM {t}" for t, (n, m, c) in _FILES.items())}),
        k AS (SELECT *, CASE WHEN mime LIKE 'application/json%' THEN 'json_log' WHEN filename LIKE '%.VTT' THEN 'transcript_text' WHEN filename LIKE '%.log' THEN 'log_text' WHEN filename LIKE '%.md' THEN 'plain_text' END AS parser_type FROM f),
        good AS MATERIALIZED (SELECT filename, content FROM k WHERE parser_type = 'json_log' AND json_valid(content)),
        j AS (SELECT filename, string_agg(CASE WHEN path = '' THEN shown ELSE path || '=' || shown END, chr(10) ORDER BY place) AS body FROM ({_LEAVES.format(key="filename", table="good", json="content")}) GROUP BY 1),
        c AS (SELECT filename, pos, {_trimmed("regexp_replace(line, '<[^>]+>', '', 'g')")} AS line FROM (SELECT filename, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM (SELECT filename, list_transform(string_split_regex(content, '\r\n|[\n\r]'), lambda y: {_trimmed("y")}) AS x FROM k WHERE parser_type = 'transcript_text'))
            WHERE line NOT IN ('', 'WEBVTT') AND NOT contains(line, '-->') AND NOT regexp_full_match(line, '\d+')),
        v AS (SELECT filename, string_agg(line, chr(10) ORDER BY pos) AS body FROM (SELECT *, lag(line) OVER (PARTITION BY filename ORDER BY pos) AS last FROM c WHERE line <> '') WHERE last IS NULL OR last <> line GROUP BY 1),
        r AS (SELECT k.filename, parser_type, CASE WHEN parser_type IS NULL THEN 'unsupported' WHEN parser_type = 'json_log' AND NOT json_valid(content) THEN 'failed' ELSE 'completed' END AS status, octet_length(encode(content)) AS byte_count,
            {_trimmed("CASE parser_type WHEN 'json_log' THEN j.body WHEN 'transcript_text' THEN coalesce(v.body, '') ELSE CASE WHEN parser_type IS NOT NULL THEN content END END")} AS artifact_text FROM k LEFT JOIN j USING (filename) LEFT JOIN v USING (filename))
        SELECT filename, parser_type, status, byte_count, CASE WHEN status <> 'completed' THEN 0.0 WHEN parser_type = 'json_log' THEN 0.99 WHEN parser_type = 'transcript_text' THEN 0.97 ELSE 1.0 END::DOUBLE AS parser_confidence,
            artifact_text, CASE WHEN artifact_text = '' THEN 0 ELSE length(artifact_text) - length(replace(artifact_text, chr(10), '')) + 1 END AS line_count FROM r""",
)
def attachment_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's text by its parser: detection by type and name, transcripts without cues, nested JSON a line a leaf."""
    parts = [load(spark, sf_dir, t).selectExpr(f"{n} AS filename", f"{m} AS mime", f"CAST({c} AS BINARY) AS content") for t, (n, m, c) in _FILES.items()]
    found = artifact_texts(reduce(DataFrame.unionByName, parts))
    return found.select("filename", "parser_type", "status", F.col("byte_count").cast("long").alias("byte_count"), "parser_confidence", "artifact_text", F.col("line_count").cast("long").alias("line_count"))


@query(
    "g60_nested_strings",
    rf"""WITH r AS MATERIALIZED (SELECT doc_id, concat('{{"note":{{"first":', to_json(coalesce(left(text, 700), ''))::VARCHAR, ',"n":[', CAST(doc_id AS VARCHAR(20)), ',null,', to_json(coalesce(text, ''))::VARCHAR, ']}},"lang":', coalesce(to_json(lang)::VARCHAR, 'null'), '}}') AS record FROM documents),
        s AS (SELECT doc_id, place, {_trimmed("shown")} AS s FROM ({_LEAVES.format(key="doc_id", table="r", json="record")}) WHERE type = 'VARCHAR'),
        b AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM s WHERE s <> '')
        SELECT d.doc_id, coalesce(string_agg(left(s, CAST({MOST_STRINGS} - used AS BIGINT)), '|' ORDER BY place), '') AS strings FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND used < {MOST_STRINGS} GROUP BY d.doc_id""",
)
def nested_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strings of a nested record of every document, within a budget of characters, as they go into the text to embed."""
    text = F.coalesce("text", F.lit(""))
    note = F.struct(F.left(text, F.lit(700)).alias("first"), F.array(F.lit(None).cast("string"), text).alias("n"))
    record = F.to_json(F.struct(note.alias("note"), F.col("doc_id").alias("n"), F.col("lang")))
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(json_strings(record, MOST_STRINGS), "|").alias("strings"))
