"""Structured chunks: the rules that make one, budget and cover; and which chunker a record goes to."""

import random

from pyspark.sql import functions as F

from tessera.functions import sections as S
from tessera.operators.chunking import dispatched_chunks, document_chunks

ELEMENT = "array<struct<kind:string,text:string,section:array<string>>>"


def chunked(spark, elements, title=None, **kw):
    df = spark.createDataFrame([(1, title, elements)], f"id int, title string, elements {ELEMENT}")
    return [(r["kind"], r["section"], r["text"]) for r in document_chunks(df, "id", **kw).orderBy("chunk").collect()]


def test_headings_open_chunks_and_lead_the_next_one_in(spark):
    got = chunked(spark, [("heading", "Error:", ["Error:"]), ("paragraph", "No session.", ["Error:"]), ("heading", "How", ["How"]), ("heading", "Fix", ["How", "Fix"]), ("paragraph", "Shorten it.", ["How", "Fix"]), ("heading", "End", ["End"])], "Card")
    assert got == [("heading_section", "Error:", "Card\n\nError:\nNo session."), ("heading_section", "How > Fix", "How\nFix\nShorten it.")]


def test_a_step_keeps_its_warning_and_figure(spark):
    s = ["Resolution"]
    got = chunked(spark, [("heading", "Resolution", s), ("paragraph", "1. Stop it", s), ("paragraph", "Warning: all jobs end", s), ("figure", "[console]", s), ("paragraph", "2) Start it", s)])
    assert got == [("procedure_step", "Resolution", "Resolution\n1. Stop it\nWarning: all jobs end\n[console]"), ("procedure_step", "Resolution", "2) Start it")]
    assert chunked(spark, [("paragraph", "1. RFC 4271", ["References"]), ("paragraph", "2. RFC 793", ["References"])])[0][0] == "heading_section"
    assert [k for k, _, _ in chunked(spark, [("paragraph", "Step 1: look", ["Intro"]), ("paragraph", "step 2. act", ["Intro"])])] == ["procedure_step"] * 2


def test_large_tables_stand_alone_and_code_is_told_by_its_lines(spark):
    s, big = ["Data"], "x " * S.TABLE_ALONE
    got = chunked(spark, [("paragraph", "before", s), ("table", "small", s), ("table", big, s), ("paragraph", "port = 80\nhost = a\nthat is all", s)])
    assert [k for k, _, _ in got] == ["heading_section", "table", "code_block"]
    assert got[0][2] == "before\nsmall"
    assert chunked(spark, [("figure", "[a]", s)])[0][0] == "figure" and chunked(spark, [("paragraph", "Never: do this", s)])[0][0] == "warning"


def test_empty_and_null(spark):
    assert chunked(spark, []) == chunked(spark, None) == chunked(spark, [("paragraph", None, None), ("paragraph", " ", [])]) == []
    assert chunked(spark, [(None, "a", None)]) == [("heading_section", "", "a")]


def test_chunks_cover_the_text_within_the_budget(spark):
    rng = random.Random(3)
    element = lambda i: (rng.choice(["heading", "paragraph", "paragraph", "table", "figure", "list_item"]), rng.choice(["", "1. ", "note: "]) + f"w{i} " * rng.randint(1, 40), rng.choice([["Fix"], ["Data"]]))
    docs = [(d, "", [element(i) for i in range(rng.randint(1, 60))] + [("paragraph", "end", ["z"])]) for d in range(30)]
    out = document_chunks(spark.createDataFrame(docs, f"id int, title string, elements {ELEMENT}"), "id", target=300).orderBy("id", "chunk").collect()
    for d, _, elements in docs:
        mine = [r for r in out if r["id"] == d]
        assert "\n".join(r["text"] for r in mine) == "\n".join(t.strip() for _, t, _ in elements)
        assert sum(r["elements"] for r in mine) == len(elements) and [r["chunk"] for r in mine] == list(range(len(mine)))
        prose = [r["text"] for r in mine if "note:" not in r["text"]]
        assert all(len(t) < 300 + 6 * 200 for t in prose)


def test_records_go_to_their_chunker(spark):
    cases = {("local_file", "kb_article"): "document", ("servicenow", "kb_article"): "document", ("zoho_desk", "sop"): "document", ("servicenow", "incident"): "ticket", ("gmail", "message"): "thread", ("unknown", "attachment"): "attachment", (None, None): "fallback", ("teams", "attachment"): "thread"}
    rows = spark.createDataFrame([(i, s, e, "T", "body text\n> quoted", None) for i, (s, e) in enumerate(cases)], f"id int, source_type string, evidence_type string, title string, body string, elements {ELEMENT}")
    got = {r["id"]: (r["chunker"], r["text"]) for r in dispatched_chunks(rows, "id").collect()}
    assert [got[i][0] for i in range(len(cases))] == list(cases.values())
    assert got[3][1] == "T\n\nbody text\n> quoted" and got[4][1].strip() == "body text" and got[6][1] == "body text\n> quoted"
    parsed = rows.withColumn("elements", F.array(F.struct(F.lit("paragraph").alias("kind"), F.lit("parsed").alias("text"), F.array(F.lit("S")).alias("section"))))
    assert {r["id"]: r["text"] for r in dispatched_chunks(parsed, "id").collect()}[0] == "T\n\nparsed"
    assert dispatched_chunks(rows.withColumn("body", F.lit(None).cast("string")).withColumn("title", F.lit(None).cast("string")), "id").count() == 0
