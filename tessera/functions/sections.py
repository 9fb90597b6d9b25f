"""Elements of structured documents: which are steps, warnings and code, and in which chunk each goes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Size of a chunk, from where a table stands alone, what starts a warning and a step, sections whose numbered lines are steps, lines of code and how many make a chunk code.
TARGET_CHARS, TABLE_ALONE = 1500, 400
WARNING = r"(?i)^\s*(warning|caution|danger|important|note|attention|do not|never)\b[:!.\s]"
STEP = r"(?i)^\s*(?:step\s+)?\d+[.):]\s*\S"
SPELT_STEP = r"(?i)^step "
PROCEDURE = r"(?i)\b(procedure|steps?|instructions?|remediation|resolution|solution|reproduce|workaround|fix|rollback|verification|configuration)\b"
CODE_LINE = (
    r"(?i)^\s*("
    r"</?[A-Za-z][\w:.-]*[\s/>]"
    r"|[A-Za-z_.]+\s*=\s*\S"
    r"|(?:sudo|cd|ls|cp|mv|rm|chmod|chown|systemctl|service|docker|kubectl|curl|wget|java|python|pip|npm|git|psql|mysql|export|set|net|sc|tasklist|netstat)\s"
    r"|[$#>]\s*\S"
    r"|at\s+[\w$.]+\([^)]*\)"
    r"|[{}\[\]();]\s*$"
    r")"
)
CODE_SHARE, LEAST_CODE_LINES = 0.6, 2

#: What a record is chunked as, by its own type before its source.
DOCUMENT_TYPES = ("kb_article", "sop", "documentation", "runbook")
TICKET_SOURCES = ("jira_sm", "servicenow", "sapphireims", "zoho_desk")
THREAD_SOURCES = ("gmail", "teams")


def chunker_of(source: Column, evidence: Column) -> Column:
    """``document``, ``ticket``, ``thread``, ``attachment`` or ``fallback``; unknown and null go to the last."""
    return F.when(evidence.isin(*DOCUMENT_TYPES), "document").when(source.isin(*TICKET_SOURCES), "ticket").when(source.isin(*THREAD_SOURCES), "thread").when(evidence == "attachment", "attachment").otherwise("fallback")


def path_of(section: Column) -> Column:
    return F.array_join(section, " > ")


def is_step(text: Column, section: Column) -> Column:
    """A numbered line that says ``step`` or stands in a section on a procedure; elsewhere it may be a citation."""
    return F.coalesce(text.rlike(STEP) & (text.rlike(SPELT_STEP) | F.array_join(section, " ").rlike(PROCEDURE)), F.lit(False))


def numbers(kinds: list[dict], target: int) -> list[int]:
    """The chunk of each element, from 1: headings and large tables open one, a second step too; prose closes one that has ``target`` characters, warnings, figures and small tables stay with what is before them."""
    out, chunk, open_, chars, step = [], 0, False, 0, False
    for e in kinds:
        plain = e["kind"] not in ("heading", "table", "figure")
        alone = e["kind"] == "table" and e["chars"] >= TABLE_ALONE
        if not open_ or e["kind"] == "heading" or alone or plain and e["step"] and step:
            chunk, chars, step = chunk + 1, 0, False
        chars += e["chars"]
        step |= plain and e["step"]
        open_ = not (alone or plain and not e["warning"] and chars >= target)
        out.append(chunk)
    return out


def chunk_numbers(elements: Column, target: int) -> Column:
    """array<int> beside ``elements``: array<struct<kind, text, section>>."""

    @F.arrow_udf("array<int>")
    def numbered(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in rows:
            yield pa.array([None if x is None else numbers(x, target) for x in col.to_pylist()], pa.list_(pa.int32()))

    facts = lambda e: F.struct(F.coalesce(e["kind"], F.lit("paragraph")).alias("kind"), F.length(F.coalesce(e["text"], F.lit(""))).alias("chars"), is_step(e["text"], e["section"]).alias("step"), F.coalesce(e["text"].rlike(WARNING), F.lit(False)).alias("warning"))
    return numbered(F.transform(elements, facts))
