"""Text of attachments: detection, transcripts and JSON against plain recursion."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.artifacts import artifact_texts, json_strings


def texts(spark, *files):
    rows = artifact_texts(spark.createDataFrame([(k, *f) for k, f in enumerate(files)], "k int, filename string, mime string, content binary")).orderBy("k").collect()
    return rows if len(files) > 1 else rows[0]


def recursed(value, path=""):
    """The leaves of a value, one by one, by plain recursion."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in recursed(v, f"{path}.{k}" if path else k)]
    if isinstance(value, list):
        return [x for k, v in enumerate(value) for x in recursed(v, f"{path}[{k}]")]
    return [(path, value)]


def made(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([None, True, False, 7, -1.5, 1e30, "x", " padded ", "", "été \n line", "ключ"])
    if rng.random() < 0.5:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice("zyxabc") + str(k): made(rng, depth - 1) for k in range(rng.randrange(4))}


def test_detection(spark):
    cases = {
        ("a.JSON", None): "json_log", ("a.ndjson", "text/plain"): "json_log", ("a.txt", " Application/JSON ; charset=x"): "json_log", ("a.vtt", None): "transcript_text",
        ("a", "text/vtt"): "transcript_text", ("a.log", "text/plain"): "log_text", ("a.tar.err", None): "log_text", ("a.md", None): "plain_text", ("a.bin", "text/html"): "plain_text",
        (None, "text/css"): "plain_text", ("a.bin", None): None, (".log", None): None, ("dir.log/a", None): None, (None, None): None, ("", ""): None,
    }
    rows = texts(spark, *[(name, mime, b"{}") for name, mime in cases])
    assert [r.parser_type for r in rows] == list(cases.values())
    assert all((r.status == "unsupported") == (r.parser_type is None) for r in rows)
    assert rows[-1].error == "unsupported_artifact_type" and rows[-1].artifact_text is None and rows[-1].parser_confidence == 0.0


def test_transcripts(spark):
    vtt = "﻿WEBVTT\r\n\r\n1\r\n00:01.000 --> 00:02.000\r\n<v Ann>Hello there</v>\r\n\r\n2\r\n00:02.000 --> 00:03.000\r\nHello there\r\n<c></c>\r\n 12 apples \r\nHello there\r\n"
    r = texts(spark, ("call.vtt", None, vtt.encode()))
    assert r.artifact_text == "Hello there\n12 apples\nHello there" and (r.line_count, r.parser_confidence, r.byte_count) == (3, 0.97, len(vtt.encode()))
    assert texts(spark, ("call.srt", None, b"1\n00 --> 01\n\n")).line_count == 0


def test_encodings_nulls_and_empty_files(spark):
    rows = texts(spark, ("a.txt", None, "grün".encode("utf-16")), ("a.txt", None, b"\xff\xfe\xff"), ("a.txt", None, None), ("a.log", None, b""), ("a.json", None, None))
    assert rows[0].artifact_text == "grün" and "�" in rows[1].artifact_text
    assert [(r.status, r.artifact_text, r.line_count, r.byte_count) for r in rows[2:4]] == [("completed", "", 0, 0)] * 2
    assert rows[4].status == "failed" and rows[4].error.startswith("invalid_json: ")


@pytest.mark.parametrize("text, want", [('{"a":{"b":[1,{"c":null}]},"d":true}', "a.b[0]=1\na.b[1].c=null\nd=True"), ("[]", ""), ('" "', ""), ("[[3]]", "[0][0]=3"), ('{"a":1}\n{"a":2}', None), ('{"a":', None)])
def test_json(spark, text, want):
    r = texts(spark, ("a.json", None, text.encode()))
    assert (r.status, r.artifact_text) == (("completed", want) if want is not None else ("failed", None))


def test_json_of_any_depth_equals_recursion(spark):
    rng = random.Random(5)
    values = [made(rng, 5) for _ in range(60)] + [json.loads("[" * 400 + '"deep"' + "]" * 400)]
    rows = texts(spark, *[("a.json", None, json.dumps(v).encode()) for v in values])
    for r, v in zip(rows, values, strict=True):
        lines = [f"{p}={'null' if x is None else x}" if p else ("null" if x is None else str(x)) for p, x in recursed(v)]
        assert r.artifact_text == "\n".join(line for line in lines if line.strip()).strip()


@pytest.mark.parametrize("budget", [1, 9, 1000])
def test_strings_within_a_budget(spark, budget):
    rng = random.Random(6)
    values = [made(rng, 4) for _ in range(60)]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)] + [(60, None), (61, "{")], "k int, j string")
    got = [r.s for r in df.select("k", json_strings(F.col("j"), budget).alias("s")).orderBy("k").collect()]
    for s, v in zip(got, values, strict=False):
        want, room = [], budget
        for x in (x.strip() for _, x in recursed(v) if isinstance(x, str)):
            if x and room > 0:
                want.append(x[:room])
                room -= len(x)
        assert s == want and sum(map(len, s)) <= budget
    assert got[60:] == [[], []]


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([("a.txt", None, b"x", "old", 5, 1)], "filename string, mime string, content binary, error string, line_count int, other int")
    out = artifact_texts(df)
    assert out.columns.count("error") == out.columns.count("line_count") == 1
    assert (out.first().line_count, out.first().error, out.first().other) == (1, None, 1)
