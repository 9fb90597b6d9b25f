"""Office files as rows of typed elements, from Spark's ``binaryFile`` source."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx_elements(content: bytes) -> list[tuple[str, str]]:
    """(kind, text) of headings, paragraphs and table rows; deleted revisions are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))  # noqa: E731  deleted text is in w:delText
    out = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            kind = "heading" if style is not None and style.get(f"{_W}val", "").lower().startswith("heading") else "paragraph"
            if content_ := text(node).strip():
                out.append((kind, content_))
        elif node.tag == f"{_W}tbl":
            out += [("table_row", " | ".join(text(c).strip() for c in row.iter(f"{_W}tc"))) for row in node.iter(f"{_W}tr")]
    return out


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """``path, pos, kind, text`` of every element; a file that can't be read gives one row of kind ``error``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, content in zip(b["path"], b["content"], strict=True):
                try:
                    found = _docx_elements(content)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    found = [("error", str(e))]
                rows += [(name, k, kind, text) for k, (kind, text) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "pos", "kind", "text"])

    return files.mapInPandas(parse, "path string, pos int, kind string, text string")
