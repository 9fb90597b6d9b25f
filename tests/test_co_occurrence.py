"""Suppliers that meet in orders."""


def test_co_occurrence_joins_nothing(spark, tmp_path):
    from tessera.plans.registry import QUERIES

    rows = [(o, x) for o in range(3) for x in (4, 2, 9, 2)] + [(None, 2), (None, 4), (7, 2), (7, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["j07_co_occurrence"](spark, str(tmp_path))
    assert [(x.low, x.high, x.n) for x in found.collect()] == [(2, 4, 3), (2, 9, 3), (4, 9, 3)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
