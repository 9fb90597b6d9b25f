from tessera.plans import registry

DIR = "/root/testdata/sf0.001"


def test_arms_are_ranked_once(spark):
    plan = registry.QUERIES["g21_hybrid_rank"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan and "text#" not in plan
