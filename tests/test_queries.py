"""Every registered query of the reference's operators against its SQL twin, on the smallest tables."""

import math

import duckdb
import pytest

from tessera.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck):
    df = registry.QUERIES[name](spark, DIR)
    rows = [r.asDict() for r in df.collect()]
    if name not in registry.ORACLE_SQL:
        assert len(df.columns) == len(set(df.columns))
        return
    got = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    want = [dict(zip(names, r, strict=True)) for r in got.fetchall()]
    key = sorted(names)
    assert sorted(tuple(plain(r[k]) for k in key) for r in rows) == sorted(tuple(plain(r[k]) for k in key) for r in want)
