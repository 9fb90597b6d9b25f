"""Counts of followers against all pairs."""

import random

from tessera.operators import followers as O


def test_equals_all_pairs_in_several_shares(spark, monkeypatch):
    for name, value in (("MOST_FIRST", 40), ("MOST_LATER", 30), ("LEAST_WAYS", 3)):
        monkeypatch.setattr(O, name, value)
    r = random.Random(4)
    draw = lambda ids, n: [(r.choice(ids), r.randrange(4), r.randrange(60)) for _ in range(n)]
    first, later = draw([None, *range(12)], 90) + [(50, 9, 1)], draw([None, *range(30)], 110)
    schema = "id long, k long, at long"
    got = {x.id: (x.n, x["first"], x.total) for x in O.followers(spark.createDataFrame(first, schema), spark.createDataFrame(later, schema), 7).collect()}
    want = {}
    for i, k, at in first:
        want.setdefault(i, set()).update(j for j, key, then in later if key == k and at < then <= at + 7)
    known = lambda s: [j for j in s if j is not None]
    assert got == {i: (len(s), min(known(s), default=None), sum(known(s)) if known(s) else None) for i, s in want.items() if s}
    assert not O.followers(spark.createDataFrame([], schema), spark.createDataFrame(later, schema), 7).count()


def test_no_pair_becomes_a_row(spark):
    """A thousand changes and a thousand incidents on one item are a million pairs; what leaves the tasks is a row a change and share."""
    rows = lambda start: spark.range(start, start + 1000).selectExpr("id", "1L AS k", "id AS at")
    found = O.followers(rows(0), rows(1000), 5000)
    assert [tuple(x) for x in found.groupBy("n").count().collect()] == [(1000, 1000)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
