"""Chunks of records: structured documents by their own structure, all others by the chunker of their kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import chunks as C
from tessera.functions import messages as M
from tessera.functions import sections as S

CHUNK = ("chunk", "kind", "section", "elements", "text")


def document_chunks(documents: DataFrame, key: str, target: int = S.TARGET_CHARS) -> DataFrame:
    """``key, chunk, kind, section, elements, text`` of ``documents(key, title, elements)``.

    ``elements`` is an array<struct<kind, text, section>> in reading order.  A
    chunk keeps to one section and holds one step of a procedure, with its
    warnings and figures; prose is closed at ``target`` characters, so a chunk
    has that many and its last elements at most.  A chunk that is only its
    heading leads the next one in; at the end of a document it is dropped.  The
    title goes before the first chunk.  ``elements`` counts what a chunk holds.
    Null and empty texts add nothing, a document without text has no row; keys
    are taken to be unique.

    The fold over a document's elements sees their sizes and kinds only; texts
    are shuffled once, by document.
    """
    numbered = documents.select(key, "title", "elements", S.chunk_numbers(F.col("elements"), target).alias("_n"))
    each = numbered.select(key, "title", F.posexplode(F.arrays_zip("elements", "_n")).alias("pos", "e")).select(key, "title", "pos", F.col("e._n").alias("part"), F.coalesce("e.elements.kind", F.lit("paragraph")).alias("kind"), F.trim(F.coalesce("e.elements.text", F.lit(""))).alias("text"), F.coalesce("e.elements.section", F.array().cast("array<string>")).alias("section"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    text = F.col("text")
    parts = (
        each.repartition(key)
        .groupBy(key, "part")
        .agg(
            F.first("title").alias("title"),
            F.min_by("section", "pos").alias("section"),
            F.count("*").alias("elements"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(text != "", F.struct("pos", "text")))), lambda x: x["text"]), "\n").alias("text"),
            F.bool_or(text.rlike(S.STEP)).alias("numbered"),
            F.bool_or(text.rlike(S.STEP) & text.rlike(S.SPELT_STEP)).alias("spelt"),
            F.bool_or(text.rlike(S.WARNING)).alias("warns"),
            F.bool_and(F.col("kind") == "table").alias("tables"),
            F.bool_and(F.col("kind") == "figure").alias("figures"),
            F.sum(F.size(lines)).alias("lines"),
            F.sum(F.size(F.filter(lines, lambda x: x.rlike(S.CODE_LINE)))).alias("code"),
        )
        .where("text <> ''")
    )
    step = F.col("spelt") | (F.col("numbered") & F.array_join("section", " ").rlike(S.PROCEDURE))
    code = (F.col("lines") >= S.LEAST_CODE_LINES) & (F.col("code") / F.col("lines") >= S.CODE_SHARE)
    kind = F.when(step, "procedure_step").when(F.col("warns"), "warning").when(F.col("tables"), "table").when(F.col("figures"), "figure").when(code, "code_block").otherwise("heading_section")
    path = S.path_of(F.col("section"))
    bare = (path != "") & ~F.col("text").contains("\n") & path.endswith(F.col("text"))
    by_part = Window.partitionBy(key).orderBy("part")
    led = parts.withColumns({"kind": kind, "path": path, "bare": bare}).withColumn("chunk", F.coalesce(F.sum(F.when(~F.col("bare"), 1).otherwise(0)).over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    own = F.struct("kind", "path")
    merged = led.groupBy(key, "chunk").agg(F.first("title").alias("title"), F.max_by(own, "part").alias("own"), F.sum("elements").alias("elements"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n").alias("text"), F.bool_and("bare").alias("bare"))
    titled = F.when((F.col("chunk") == 0) & (F.coalesce("title", F.lit("")) != ""), F.concat("title", F.lit("\n\n"), "text")).otherwise(F.col("text"))
    return merged.where("NOT bare").select(key, "chunk", "own.kind", F.col("own.path").alias("section"), "elements", titled.alias("text"))


def _spans(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """Chunks of ``text``, cut at paragraphs, lines or sentences."""
    cut = rows.where("trim(text) <> ''").select(key, "text", F.posexplode(C.chunk_spans(F.col("text"))).alias("chunk", "s"))
    return cut.select(key, "chunk", F.lit(kind).alias("kind"), F.lit("").alias("section"), F.lit(1).cast("long").alias("elements"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("text"))


def dispatched_chunks(records: DataFrame, key: str) -> DataFrame:
    """``key, chunker, chunk, kind, section, elements, text`` of ``records(key, source_type, evidence_type, title, body, elements)``.

    Each record goes to the chunker of its kind: documents with elements by
    structure; documents without, attachments and unknown records as prose;
    tickets with their title; messages without their quoted part.  Null and
    blank bodies have no row.
    """
    sent = records.withColumn("chunker", S.chunker_of(F.col("source_type"), F.col("evidence_type")))
    of = lambda name: sent.where(F.col("chunker") == name)
    parsed = F.coalesce(F.size("elements") > 0, F.lit(False))
    body, titled = F.coalesce("body", F.lit("")), F.concat_ws("\n\n", F.nullif("title", F.lit("")), "body")
    out = [
        ("document", document_chunks(of("document").where(parsed), key)),
        ("document", _spans(of("document").where(~parsed).select(key, titled.alias("text")), key, "prose")),
        ("ticket", _spans(of("ticket").where("trim(body) <> ''").select(key, titled.alias("text")), key, "ticket_body")),
        ("thread", _spans(of("thread").select(key, M.fresh_text(body).alias("text")), key, "message")),
        ("attachment", _spans(of("attachment").select(key, titled.alias("text")), key, "prose")),
        ("fallback", _spans(of("fallback").select(key, body.alias("text")), key, "prose")),
    ]
    named = [df.select(key, F.lit(name).alias("chunker"), *CHUNK) for name, df in out]
    whole = named[0]
    for df in named[1:]:
        whole = whole.unionByName(df)
    return whole
