"""Overlaps and containment of sets against all pairs, with sets too large for their pairs."""

import random

from tessera.operators import dedup


def test_overlaps_and_containment_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PAIRED", 5)
    r = random.Random(11)
    sets = {i: set(r.sample(range(25), r.choice([1, 1, 2, 2, 3, 4, 5, 6, 9]))) for i in range(120)}
    sets |= {200: set(sets[3]), 201: set(range(20)), 202: set(range(12)), 203: {999}, 204: {999}}
    rows = [(i, x) for i, s in sets.items() for x in s] + [(3, x) for x in sets[3]] + [(1, None)]
    frame = spark.createDataFrame(rows, "id long, item long")
    both = sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 2)
    assert sorted(map(tuple, dedup.overlaps(frame).collect())) == both
    inside = sorted(a for a in sets if any(a != b and sets[a] <= sets[b] and (sets[a] != sets[b] or b < a) for b in sets))
    nulls = spark.createDataFrame([(1, 1), (1, None), (2, 1), (3, 1), (3, None), (4, 7), (4, 8), (5, 7), (5, 8), (5, None)], "id long, item long")
    assert sorted(x["id"] for x in dedup.contained_sets(nulls).collect()) == [2, 4]
    assert sorted(x["id"] for x in dedup.contained_sets(frame.where("item IS NOT NULL")).collect()) == inside


def test_sets_that_share_one_item_only_do_not_meet(spark):
    frame = spark.range(3000).selectExpr("explode(array((id, 1L), (id, id + 10))) AS p").selectExpr("p.id AS id", "p.col2 AS item")
    assert dedup.overlaps(frame).count() == 0 and dedup.contained_sets(frame).count() == 0
