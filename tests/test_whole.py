"""Operators over whole tables against brute force."""

import random

from pyspark.sql import functions as F

from tessera.operators.graph import decision_chains
from tessera.operators.tables import global_rank
from tessera.plans import registry

DIR = "/root/testdata/sf0.001"


def brute_chain(root, parent, children, most):
    seen, up, at = set(), [], root
    while at in parent and parent[at] is not None and len(up) < most and parent[at] not in seen:
        seen.add(parent[at])
        at = parent[at]
        if at in parent:
            up.append(at)
    chain = up[::-1]
    if root not in seen:
        chain.append(root)
        seen.add(root)
    queue = [root]
    while queue and len(chain) < most:
        for c in children.get(queue.pop(0), ()):
            if c not in seen:
                seen.add(c)
                chain.append(c)
                queue.append(c)
    return chain


def test_decision_chains_up_and_down(spark):
    r = random.Random(3)
    rows = [(1, None, 1), (2, 999, 1), (100, 102, 1), (101, 100, 1), (102, 101, 1), (103, 101, 2)]
    rows += [(i, r.choice((1, 2, i - 1, i - 1, r.randrange(1, i))), r.randrange(9)) for i in range(3, 60)]
    rows += [(200, None, 1), *((i, i - 1, 0) for i in range(201, 230))]
    parent, children = {i: p for i, p, _ in rows}, {}
    for i, p, _ in sorted(rows, key=lambda x: (x[2], x[0])):
        children.setdefault(p, []).append(i)
    for most in (7, 20):
        found = {}
        for x in decision_chains(spark.createDataFrame(rows, "id long, parent long, at int"), most).orderBy("root", "place").collect():
            found.setdefault(x.root, []).append(x.id)
        assert found == {i: brute_chain(i, parent, children, most) for i in parent}, most


def test_every_order_has_a_chain_and_every_customer_a_rank(spark):
    orders = spark.read.parquet(f"{DIR}/orders.parquet")
    assert registry.QUERIES["g10_decision_chain_all"](spark, DIR).select("root").distinct().count() == orders.count()
    assert registry.QUERIES["t09_null_placement_all"](spark, DIR).count() == orders.select("o_custkey").distinct().count()


def test_global_rank_over_ranges(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    found = {x.id: x.n for x in global_rank(rows, (F.desc_nulls_first("v"), F.asc("id")), "n").collect()}
    want = sorted(range(5000), key=lambda i: (i % 3 > 0, -(i * 7919 % 1000) if i % 3 else 0, i))
    assert found == {i: k + 1 for k, i in enumerate(want)}
    assert global_rank(rows.limit(0), (F.asc("id"),), "n").count() == 0


def test_decision_chains_go_up_in_doubling_rounds(spark, monkeypatch):
    from tessera.operators import graph

    kept = []
    monkeypatch.setattr(graph, "saved", lambda df, save=graph.saved: kept.append(1) or save(df))
    rows = spark.createDataFrame([(1, 1, 0), *((i, i - 1, 0) for i in range(2, 40))], "id long, parent long, at int")
    found = decision_chains(rows).where("root = 30").orderBy("place").collect()
    assert [(x.id, x.depth, x.place) for x in found] == [(i, i - 30, i - 9) for i in range(10, 31)]
    # The way down starts with one node of each level; up to 20 ancestors take 5 rounds.
    assert len(kept) <= 7 + 20
    assert [x.id for x in decision_chains(rows).where("root = 1").orderBy("place").collect()] == list(range(1, 21))
