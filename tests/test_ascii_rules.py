"""Rules on texts with letters, digits and blanks outside ASCII, against their SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.plans import registry

TEXTS = ["é123 x", "café2024-01-02é", "a\x0bb 4567", "\xa0 12:30  ", "x 4567 \x85", "é0xAB12\nßUTC", "", None]
TITLES = ["Laèaitrean", "tableau la", "éla é", "theé", "İthe end", "fehlerü", "der", "", None]


def rows_of(spark, folder, name, table, columns):
    pq.write_table(pa.table(columns), folder / f"{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    got = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    return {tuple(r) for r in registry.QUERIES[name](spark, str(folder)).select(*names).collect()}, set(got.fetchall())


@pytest.mark.parametrize("name", ["f15_error_normalise", "f12_phrase_match"])
def test_lines(name, spark, tmp_path):
    texts = [*TEXTS, "éwith the x", "of thisé"]
    got, want = rows_of(spark, tmp_path, name, "documents", {"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    assert got == want


def test_titles(spark, tmp_path):
    html = [None if t is None else f"<title>{t}</title>" for t in TITLES]
    got, want = rows_of(spark, tmp_path, "g58_section_purpose", "pages", {"page_id": list(range(len(html))), "html": pa.array(html, pa.string())})
    assert got == want
