"""The edges around an entity."""

from tessera.plans.registry import QUERIES


def test_edges_are_looked_up_before_they_are_shuffled(spark, tmp_path):
    rows = [(2, 5), (2, 5), (2, 6), (0, 5), (0, 5), (1, 7), (3, 6), (9, 8)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["g03_entity_subgraph"](spark, str(tmp_path))
    assert sorted((x.src, x.dst) for x in found.collect()) == [(-4, 6), (-3, 5), (-3, 6), (-1, 5)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
