"""Export folders as a data source: whole, by range, since a checkpoint, as a stream with a restart."""

import json
import os

import pytest

from tessera.sources import export_files as E


def put(folder, name, ids, time, at="2026-08-01 10:00:00"):
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_text(json.dumps({"source": "chat", "thread_id": name, "messages": [{"user": "ann", "timestamp": at, "text": i} for i in ids]}))
    os.utime(path, ns=(time, time))


def texts(df):
    return sorted(r["text"] for r in df.collect())


@pytest.fixture
def folder(tmp_path):
    put(tmp_path / "in", "a.json", ["a1", "a2"], 10**18)
    put(tmp_path / "in", "b.json", ["b1"], 10**18 + 5, at="2026-08-02 00:00:00")
    put(tmp_path / "in", "c.json", ["c1"], 10**18 + 5, at="no date")
    put(tmp_path / "in", ".hidden", ["no"], 10**18)
    (tmp_path / "in" / "broken.json").write_bytes(b"{\xff")
    os.utime(tmp_path / "in" / "broken.json", ns=(10**18, 10**18))
    return tmp_path / "in"


def test_backfill_by_range(spark, folder, monkeypatch):
    assert texts(E.backfill(spark, str(folder), "chat")) == ["a1", "a2", "b1", "c1"]
    assert texts(E.backfill(spark, str(folder), "chat", "2026-08-02", "2026-08-03")) == ["b1", "c1"]
    assert texts(E.backfill(spark, str(folder), "chat", end="2026-08-02 00:00:00")) == ["a1", "a2", "c1"]
    assert texts(E.backfill(spark, str(folder / "none"), "chat")) == []
    monkeypatch.setattr(E, "TASK_BYTES", 1)
    assert [len(p.files) for p in E.between(str(folder), E.START, E.latest(str(folder), E.START))] == [1, 1, 1, 1]


def test_changes_since_a_checkpoint(spark, folder):
    since = E.checkpoint(str(folder))
    assert texts(E.changes(spark, str(folder), "chat", None)) == []
    assert texts(E.changes(spark, str(folder), "chat", since)) == []
    put(folder, "late.json", ["d1"], 10**18 + 5)
    put(folder, "new.json", ["e1"], 10**18 + 9)
    put(folder, "old.json", ["f1"], 10**18 + 4)
    assert texts(E.changes(spark, str(folder), "chat", since)) == ["d1", "e1"]
    assert texts(E.changes(spark, str(folder), "chat", E.checkpoint(str(folder)))) == []
    assert texts(E.changes(spark, str(folder / "none"), "chat", E.checkpoint(str(folder / "none")))) == []


def test_stream_goes_on_after_a_restart(spark, folder, tmp_path):
    def run():
        out = E.changes_stream(spark, str(folder), "chat").writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "state")).start()
        out.processAllAvailable()
        out.stop()
        return texts(spark.read.parquet(str(tmp_path / "rows")))

    assert run() == ["a1", "a2", "b1", "c1"]
    assert run() == ["a1", "a2", "b1", "c1"]
    put(folder, "late.json", ["d1"], 10**18 + 5)
    put(folder, "new.json", ["e1"], 10**18 + 9)
    assert run() == ["a1", "a2", "b1", "c1", "d1", "e1"]
