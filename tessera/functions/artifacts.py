"""Text of attachments: which parser a file name and type call for, transcripts, nested JSON, strings to embed.

Detection and transcripts are column expressions.  Decoding bytes of unknown
encoding and walking JSON of any depth in the order of its keys are Arrow
functions that see one value at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File name endings and media types of each parser, encodings in the order they are tried.
TEXT_ENDINGS = (".txt", ".text", ".md", ".csv")
LOG_ENDINGS = (".log", ".out", ".err")
JSON_ENDINGS = (".json", ".jsonl", ".ndjson")
TRANSCRIPT_ENDINGS = (".srt", ".vtt", ".transcript")
JSON_TYPES = ("application/json", "application/x-ndjson")
TRANSCRIPT_TYPES = ("text/vtt", "application/x-subrip")
ENCODINGS = ("utf-8-sig", "utf-16", "utf-16-le", "utf-16-be")
#: Line ends and blanks as a text's lines and ends are cut.
_LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
_BLANKS = r"[\s\p{Z}\x1C-\x1F\x85]+"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_BLANKS}|{_BLANKS}$", "")


def media_type(mime: Column) -> Column:
    """The type without parameters in lower case; empty where there is none."""
    return F.coalesce(F.lower(stripped(F.split_part(mime, F.lit(";"), F.lit(1)))), F.lit(""))


def parser_type(filename: Column, mime: Column) -> Column:
    """``json_log``, ``transcript_text``, ``log_text``, ``plain_text`` or null; a name of an ending alone has no ending."""
    ending = F.coalesce(F.regexp_extract(F.lower(filename), r"[^/](\.[^./]+)$", 1), F.lit(""))
    media = media_type(mime)
    return (
        F.when(media.isin(*JSON_TYPES) | ending.isin(*JSON_ENDINGS), "json_log")
        .when(media.isin(*TRANSCRIPT_TYPES) | ending.isin(*TRANSCRIPT_ENDINGS), "transcript_text")
        .when(ending.isin(*LOG_ENDINGS), "log_text")
        .when(media.startswith("text/") | ending.isin(*TEXT_ENDINGS), "plain_text")
    )


def transcript_text(text: Column) -> Column:
    """The spoken lines: no header, cue numbers, times or marks, and no line twice in a row."""
    lines = F.transform(F.split(text, _LINE_END), stripped)
    cues = F.filter(lines, lambda x: ~((x == "WEBVTT") | x.rlike(r"^\p{Nd}*$") | x.contains("-->")))
    spoken = F.filter(F.transform(cues, lambda x: stripped(F.regexp_replace(x, "<[^>]+>", ""))), lambda x: x != "")
    before = F.concat(F.array(F.lit(None).cast("string")), spoken)
    pairs = F.zip_with(spoken, before, lambda x, last: F.struct(x.alias("x"), last.alias("last")))
    changed = F.filter(pairs, lambda p: p["x"].isNotNull() & (p["last"].isNull() | (p["x"] != p["last"])))
    return F.array_join(F.transform(changed, lambda p: p["x"]), "\n")


def leaves(value: object) -> Iterator[tuple[str, object]]:
    """Path and scalar of every leaf in the order of the text, at any depth; empty objects and arrays have none."""
    stack = [("", value)]
    while stack:
        path, top = stack.pop()
        if isinstance(top, dict):
            below = [(f"{path}.{key}" if path else key, item) for key, item in top.items()]
        elif isinstance(top, list):
            below = [(f"{path}[{k}]", item) for k, item in enumerate(top)]
        else:
            yield path, top
            continue
        stack.extend(reversed(below))


def _json_lines(text: str) -> tuple[str | None, str | None]:
    try:
        value = json.loads(text)
    except json.JSONDecodeError as e:
        return None, f"invalid_json: {e.msg}"
    except RecursionError:
        return None, "invalid_json: too deep"
    lines = (f"{path}={shown}" if path else shown for path, shown in ((p, "null" if v is None else str(v)) for p, v in leaves(value)))
    return "\n".join(line for line in lines if line.strip()), None


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def json_lines(text: pd.Series) -> pd.DataFrame:
    """``path=value`` of every leaf, a line each, or why the text isn't JSON; null stays null."""
    return pd.DataFrame([(None, None) if t is None else _json_lines(t) for t in text], columns=["text", "error"], dtype=object)


def _decode(data: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", errors="replace")


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes as text in the first encoding that fits; null is empty."""
    return pd.Series(["" if c is None else _decode(bytes(c)) for c in content], dtype=object)


def _strings(text: str | None, budget: int) -> list[str]:
    try:
        found = leaves(json.loads(text)) if text is not None else ()
    except (json.JSONDecodeError, RecursionError):
        return []
    out, room = [], budget
    for s in (v.strip() for _, v in found if isinstance(v, str)):
        if room <= 0:
            break
        if s:
            out.append(s[:room])
            room -= len(s)
    return out


def json_strings(text: Column, budget: int) -> Column:
    """The strings of nested JSON in the order of the text, ``budget`` characters together at most; none where it isn't JSON."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def walked(texts: pd.Series) -> pd.Series:
        return pd.Series([_strings(t, budget) for t in texts], dtype=object)

    return walked(text)


def artifact_texts(files: DataFrame) -> DataFrame:
    """``files(filename, mime, content binary)`` with ``status, parser_type, parser_confidence, artifact_text, line_count, byte_count, error``.

    A file no parser takes is ``unsupported``, JSON that can't be read
    ``failed``; both have no text.  Columns of these names are replaced, all
    others stay.
    """
    made = ("status", "parser_type", "parser_confidence", "artifact_text", "line_count", "byte_count", "error")
    kind = F.col("parser_type")
    rows = files.drop(*made).withColumn("parser_type", parser_type(F.col("filename"), F.col("mime"))).withColumn("_t", decoded(F.when(kind.isNotNull(), F.col("content"))))
    rows = rows.withColumn("_j", json_lines(F.when(kind == "json_log", F.col("_t"))))
    body = stripped(F.when(kind == "json_log", F.col("_j.text")).when(kind == "transcript_text", transcript_text(F.col("_t"))).when(kind.isNotNull(), F.col("_t")))
    status = F.when(kind.isNull(), "unsupported").when(F.col("_j.error").isNotNull(), "failed").otherwise("completed")
    rows = rows.withColumn("artifact_text", body).withColumn("status", status)
    sure = F.when(F.col("status") != "completed", 0.0).when(kind == "json_log", 0.99).when(kind == "transcript_text", 0.97).otherwise(1.0)
    count = F.when(F.col("artifact_text") == "", 0).otherwise(F.length("artifact_text") - F.length(F.replace("artifact_text", F.lit("\n"))) + 1)
    return (
        rows.withColumn("parser_confidence", sure).withColumn("line_count", count).withColumn("byte_count", F.coalesce(F.octet_length("content"), F.lit(0)))
        .withColumn("error", F.when(kind.isNull(), "unsupported_artifact_type").otherwise(F.col("_j.error"))).drop("_t", "_j")
    )
