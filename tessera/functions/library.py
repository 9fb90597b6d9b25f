"""Document names, versions, elements and sections as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Version marks of file names, the first that matches counts.
VERSION_MARKS = (
    r"(?i)(?<![a-z0-9])v(?:er(?:sion)?)?[\s._-]*(\d+(?:\.\d+)*)\b",
    r"(?i)(?<![a-z0-9])rev(?:ision)?[\s._-]*(\d+(?:\.\d+)*)\b",
    r"\(\s*(\d+)\s*\)\s*$",
)
EXTENSION = r"(?i)\.[a-z0-9]{1,5}$"
#: Words that rank a revision, and words that don't tell documents apart.
QUALIFIER_RANK = {"old": -2, "archive": -2, "archived": -2, "superseded": -2, "draft": -1, "final": 1, "updated": 1, "new": 1, "latest": 2, "current": 2}
NOISE_WORDS = ("copy", "of", "final", "updated", "new", "latest", "current", "draft", "old", "archive", "archived", "superseded", "rev", "revision", "version", "ver", "v")

#: What makes an element of an HTML page.
BLOCK = r"(?is)<(?:h[1-6]|p|li|tr|pre)\b[^>]*>.*?</(?:h[1-6]|p|li|tr|pre)>"


def stem(name: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), EXTENSION, "")


def family(name: Column) -> Column:
    """The stem without version marks and words of revision."""
    bare = reduce(lambda s, mark: F.regexp_replace(s, mark, " "), VERSION_MARKS, stem(name))
    return F.array_join(F.filter(F.regexp_extract_all(F.lower(bare), F.lit("[a-z0-9]+"), 0), lambda w: ~w.isin(*NOISE_WORDS)), " ")


def version(name: Column) -> Column:
    """The version as array<int>, which compares part by part; null without a mark."""
    marks = [F.nullif(F.regexp_extract(stem(name), mark, 1), F.lit("")) for mark in VERSION_MARKS]
    return F.transform(F.split(F.coalesce(*marks), r"\."), lambda p: p.try_cast("int"))


def qualifier_rank(name: Column, folder: Column) -> Column:
    text = F.lower(F.concat_ws(" ", folder, name))
    return reduce(lambda n, x: n + F.when(text.rlike(rf"\b{x[0]}\b"), x[1]).otherwise(0), QUALIFIER_RANK.items(), F.lit(0))


def elements(html: Column) -> Column:
    """array<struct<kind, level, text>> of a page's headings, paragraphs, list items, table rows and code, without empty ones."""

    def one(block: Column) -> Column:
        tag = F.lower(F.regexp_extract(block, r"^<(\w+)", 1))
        level = F.when(tag.startswith("h"), F.substring(tag, 2, 1).cast("int"))
        kind = F.when(tag.startswith("h"), "heading").when(tag == "li", "list_item").when(tag == "tr", "table").when(tag == "pre", "code").otherwise("paragraph")
        text = F.trim(F.regexp_replace(F.regexp_replace(block, r"(?s)<[^>]*>", " "), r"\s+", " "))
        return F.struct(kind.alias("kind"), level.alias("level"), text.alias("text"))

    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(BLOCK), 0), one), lambda e: e["text"] != "")


def rendered(items: Column) -> Column:
    """Elements as text: headings as ``#``, list items as ``-``, tables and figures apart, at most one blank line."""
    one = lambda e: F.when(e["kind"] == "heading", F.concat(F.lit("\n"), F.repeat(F.lit("#"), e["level"]), F.lit(" "), e["text"], F.lit("\n"))).when(e["kind"] == "list_item", F.concat(F.lit("- "), e["text"])).when(e["kind"] == "table", F.concat(F.lit("\n"), e["text"], F.lit("\n"))).otherwise(e["text"])
    return F.regexp_replace(F.regexp_replace(F.array_join(F.transform(items, one), "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+\z", "")


def with_paths(items: Column) -> Column:
    """Elements with ``path``, the headings above each: one of level n replaces all from level n on."""
    none = F.array().cast("array<string>")

    def step(acc: Column, e: Column) -> Column:
        path = F.when(e["kind"] == "heading", F.concat(F.slice(acc["path"], 1, F.greatest(e["level"] - 1, F.lit(0))), F.array(e["text"]))).otherwise(acc["path"])
        return F.struct(path.alias("path"), F.concat(acc["out"], F.array(F.struct(e["kind"].alias("kind"), e["text"].alias("text"), F.array_join(path, " > ").alias("path")))).alias("out"))

    start = F.struct(none.alias("path"), F.array().cast("array<struct<kind:string,text:string,path:string>>").alias("out"))
    return F.aggregate(items, start, step, lambda acc: acc["out"])
