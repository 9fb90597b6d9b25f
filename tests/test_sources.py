"""Exports, office files and keyed state of the streams, from small files."""

import json
import os
import zipfile

from pyspark.sql import functions as F

from tessera.sources.documents import read_docx
from tessera.sources.exports import read_exports, read_log_lines
from tessera.streaming.streams import drain, growth_gate


def test_exports(spark, tmp_path):
    (tmp_path / "chat").mkdir()
    (tmp_path / "chat/a.json").write_text(json.dumps({"source": "chat", "channel": "ops", "thread_id": "t1", "messages": [{"user": "ann", "timestamp": "2026-08-01 10:00:00", "text": "down"}, {"user": "bo", "timestamp": "bad", "text": None}]}))
    (tmp_path / "chat/b.json").write_text("{not json")
    rows = {r.external_id: r for r in read_exports(spark, str(tmp_path / "chat"), "chat").collect()}
    assert set(rows) == {"t1:0", "t1:1"} and rows["t1:0"].sender == "ann" and rows["t1:1"].occurred_at is None and rows["t1:1"].text is None
    (tmp_path / "alert").mkdir()
    (tmp_path / "alert/a.json").write_text(json.dumps({"source": "mon", "alert_id": "A1", "timestamp": "2026-08-01 10:00:00", "service": "db", "metric": "crash", "value": "12 crashes/min", "threshold": "5", "severity": "high", "message": "m"}))
    assert read_exports(spark, str(tmp_path / "alert"), "alert").first().text == "high crash 12 crashes/min m"
    assert {r.external_id for r in drain(read_exports(spark, str(tmp_path / "chat"), "chat", stream=True)).collect()} == {"t1:0", "t1:1"}


def test_log_lines(spark, tmp_path):
    (tmp_path / "x.log").write_text("2026-08-01 10:00:00 ERROR auth Event k=v\nsomething else\n")
    rows = read_log_lines(spark, str(tmp_path / "x.log")).collect()
    assert rows[0].level == "ERROR" and rows[0].service == "auth" and rows[0].message == "Event k=v"
    assert rows[1].level is None and rows[1].message == "something else"


def test_docx(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>kept </w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    rows = [(r.kind, r.text) for r in read_docx(spark, str(tmp_path)).orderBy("path", "pos").collect()]
    assert rows[0][0] == "error" and rows[1:] == [("heading", "Title"), ("paragraph", "kept"), ("table_row", "a | b")]


def test_growth_gate_over_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k, size in enumerate((2, 3, 4, 5, 9)):
        (src / f"{k}.json").write_text(json.dumps({"cluster": 1, "size": size, "n": k}) + "\n")
        os.utime(src / f"{k}.json", (10**9 + k, 10**9 + k))  # files of one tick may be read in any order
    stream = spark.readStream.schema("cluster long, size long, n int").option("maxFilesPerTrigger", 1).json(str(src))
    assert [r["size"] for r in drain(growth_gate(stream.select("cluster", "size"))).orderBy(F.col("size")).collect()] == [3, 5, 9]


def test_growth_gate_takes_sizes_as_they_arrive(spark, tmp_path):
    """A smaller size that arrives late is below what was sent and passes nothing."""
    src = tmp_path / "in"
    src.mkdir()
    for k, size in enumerate((9, 5, 3, 13, 14)):
        (src / f"{k}.json").write_text(json.dumps({"cluster": 1, "size": size}) + "\n")
        os.utime(src / f"{k}.json", (10**9 + k, 10**9 + k))
    stream = spark.readStream.schema("cluster long, size long").option("maxFilesPerTrigger", 1).json(str(src))
    assert [r["size"] for r in drain(growth_gate(stream)).orderBy("size").collect()] == [9, 14]
