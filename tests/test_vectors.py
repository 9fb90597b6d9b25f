"""The vector index against all pairs; greedy passes against their sequential form."""

import random

import numpy as np
import pytest

from tessera.operators import vectors as V
from tessera.operators.merging import GROUP_DISTANCE, PATTERN_DISTANCE, lead_clusters, retire_duplicates, shared_evidence

SCHEMA = "id long, space string, embedding array<float>"


def sample(n, d, seed, groups=12, spread=0.35, spaces=("x", "y", None)):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, d))
    x = centres[r.integers(0, groups, n)] + spread * r.normal(size=(n, d))
    x[5] = x[4] * 2
    return [(i, spaces[i % len(spaces)], [float(v) for v in x[i].astype(np.float32)]) for i in range(n)]


def distances(rows):
    u = np.array([r[2] for r in rows], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return np.round(1 - u @ u.T, 9)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 32)


def test_search_equals_all_distances(spark):
    rows = sample(700, 12, 1, spaces=("",))
    odd = [(9001, "", None), (9002, "", []), (9003, "", [0.0] * 12)]
    table = spark.createDataFrame(rows + odd, SCHEMA)
    index, d = V.build_index(table, 20), distances(rows)
    got = {}
    for r in V.search(index, table.where("id % 100 = 0 OR id > 9000"), 10, probes=2).collect():
        got.setdefault(r.query, []).append((r["rank"], r.distance, r.id))
    assert set(got) == set(range(0, 700, 100))
    for q, hits in got.items():
        order = sorted(range(700), key=lambda j: (d[q, j], j))[:10]
        assert [h[2] for h in sorted(hits)] == order
        assert np.allclose([h[1] for h in sorted(hits)], d[q, order], atol=2e-9)


def test_recall_of_probing_alone(spark):
    rows = sample(3000, 24, 2, groups=60, spaces=("",))
    table, d = spark.createDataFrame(rows, SCHEMA), distances(rows)
    index = V.build_index(table)
    found = [(r.query, r.id) for r in V.search(index, table.where("id % 100 = 0"), 10, probes=8, exact=False).collect()]
    true = {(q, j) for q in range(0, 3000, 100) for j in sorted(range(3000), key=lambda j: (d[q, j], j))[:10]}
    assert len(true & set(found)) >= 0.9 * len(true)
    assert sum(np.frombuffer(b.ids, np.int64).size for b in index.blocks.collect()) == 3000


def test_blocks_are_bounded_however_hot_a_cell_is(spark):
    table = spark.createDataFrame([(i, "s", [1.0, 0.5, 0.25]) for i in range(500)], SCHEMA)
    index = V.build_index(table)
    sizes = [np.frombuffer(b.ids, np.int64).size for b in index.blocks.collect()]
    assert max(sizes) <= 32 and sum(sizes) == 500
    assert [r.id for r in V.search(index, table.where("id = 7"), 3).orderBy("rank").collect()] == [0, 1, 2]


def test_near_pairs_equal_all_pairs(spark):
    rows = sample(400, 6, 3)
    d = distances(rows)
    index = V.build_index(spark.createDataFrame(rows, SCHEMA), 9)
    got = {(r.a, r.b): r.distance for r in V.near_pairs(index, 0.2).collect()}
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if rows[i][1] == rows[j][1] and d[i, j] < 0.2}
    assert set(got) == want and want and all(abs(got[p] - d[p]) < 2e-9 for p in want)
    odd, even = (V.build_index(spark.createDataFrame([r for r in rows if r[0] % 2 == k], SCHEMA), 5) for k in (1, 0))
    assert {(r.a, r.b) for r in V.near_pairs(odd, 0.2, even).collect()} == {(i, j) for i in range(1, 400, 2) for j in range(0, 400, 2) if rows[i][1] == rows[j][1] and d[i, j] < 0.2}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    index = V.build_index(none)
    assert V.near_pairs(index, 0.3).count() == 0 and V.search(index, none, 3).count() == 0
    one = spark.createDataFrame([(1, "s", [1.0, 0.0])], SCHEMA)
    assert V.search(index, one, 3).count() == 0 and V.search(V.build_index(one), one, 3).count() == 1


def test_retiring_equals_the_walk_over_sorted_pairs(spark):
    r = random.Random(11)
    for n, density in ((40, 0.1), (18, 1.0)):
        strength = {i: (r.randrange(4), r.randrange(2), r.random() if n == 40 else 0.5) for i in range(n)}
        pairs = [(i, j, round(0.85 + 0.01 * r.randrange(12), 2)) for i in range(n) for j in range(i + 1, n) if r.random() < density]
        gone, want = set(), set()
        for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
            if a not in gone and b not in gone:
                weak = b if strength[a] >= strength[b] else a
                gone.add(weak)
                want.add((weak, a + b - weak, s))
        rows = spark.createDataFrame([(b, a, s) for a, b, s in pairs], "a long, b long, similarity double")
        ranks = spark.createDataFrame([(i, *x) for i, x in strength.items()], "id long, n int, approved int, confidence double")
        assert {(x.retired, x.kept, x.similarity) for x in retire_duplicates(rows, ranks).collect()} == want
    assert retire_duplicates(rows.limit(0), ranks).count() == 0


def test_pairs_without_shared_evidence_stay(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.99), (2, 3, 0.9)], "a long, b long, similarity double")
    evidence = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (2, "y"), (3, "z"), (3, None), (1, None)], "id long, item string")
    assert [(x.a, x.b) for x in shared_evidence(pairs, evidence).collect()] == [(1, 2)]


def leaders_one_by_one(rows, near, known):
    """``near``: distance by pair; ``known``: (cluster, distance) of members seen from a row."""
    placed = {}
    d = lambda a, b: near.get((min(a, b), max(a, b)), 9.0)
    for i in sorted(rows):
        if i in placed:
            continue
        seen = [(x, c) for c, x in known.get(i, ())] + [(d(i, j), c) for j, (c, _) in placed.items()]
        best = min((s for s in seen if s[0] < PATTERN_DISTANCE), default=None)
        if best:
            placed[i] = (best[1], "joined")
            continue
        placed[i] = (str(i), "leader")
        for j in rows:
            if j not in placed and d(i, j) < GROUP_DISTANCE:
                placed[j] = (str(i), "grouped")
    return placed


def test_leaders_equal_the_sequential_pass(spark):
    r = random.Random(8)
    for n, size in ((36, 2.0), (40, 6.0)):
        at = {i: (r.random() * size, r.random() * size) for i in r.sample(range(1000), n)}
        d = lambda p, q: round(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5 / 2, 2)
        near = {(i, j): d(at[i], at[j]) for i in at for j in at if i < j and d(at[i], at[j]) < PATTERN_DISTANCE}
        old = [(f"p{k % 3}", (r.random() * size, r.random() * size)) for k in range(5)]
        known = {i: [(c, d(at[i], p)) for c, p in old if d(at[i], p) < PATTERN_DISTANCE] for i in at}
        got = lead_clusters(
            spark.createDataFrame([(i,) for i in at], "id long"), spark.createDataFrame([(a, b, x) for (a, b), x in near.items()], "a long, b long, distance double"),
            spark.createDataFrame([(i, c, x) for i, seen in known.items() for c, x in seen], "id long, cluster string, distance double"),
        ).collect()
        assert len(got) == n
        assert {x.id: (x.cluster, x.how) for x in got} == leaders_one_by_one(at, near, known)


def test_members_of_a_pattern_do_not_wait_for_each_other(spark, monkeypatch):
    """Forty rows near each other and a pattern took forty rounds; now the rounds do not grow with them."""
    from tessera.operators import merging as M

    steps = []
    monkeypatch.setattr(M, "saved", lambda df, saved=M.saved: steps.append(1) or saved(df))
    r = random.Random(2)
    near = {(i, j): r.choice((0.0, 0.1, 0.2, 0.28)) for i in range(40) for j in range(i + 1, 40)}
    known = {i: [("p1", 0.2), ("p2", 0.1 if i % 7 == 0 else 0.2)] for i in range(40)}
    got = lead_clusters(
        spark.range(40), spark.createDataFrame([(a, b, x) for (a, b), x in near.items()], "a long, b long, distance double"),
        spark.createDataFrame([(i, c, x) for i, seen in known.items() for c, x in seen], "id long, cluster string, distance double"),
    ).collect()
    assert {x.id: (x.cluster, x.how) for x in got} == leaders_one_by_one(range(40), near, known)
    assert len(steps) < 25


def test_accepting_all_gives_what_waiting_gives(spark):
    from pyspark.sql import functions as F

    r = random.Random(11)
    at = {i: (r.random() * 3, r.random() * 3) for i in r.sample(range(1000), 70)}
    d = lambda p, q: round(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5 / 2, 1)
    near = [(i, j, d(at[i], at[j])) for i in at for j in at if i < j]
    known = [(i, f"p{k}", d(at[i], p)) for i in at for k, p in enumerate([(0.1, 0.1), (2.9, 2.8)])]
    tables = (spark.createDataFrame([(i,) for i in at], "id long"), spark.createDataFrame(near, "a long, b long, distance double"), spark.createDataFrame(known, "id long, cluster string, distance double"))
    assert sorted(map(tuple, lead_clusters(*tables).collect())) == sorted(map(tuple, lead_clusters(*tables, accept=F.lit(True)).collect()))


def test_pairs_are_shuffled_only_where_an_id_is_repeated(spark, monkeypatch):
    """In runs of a few blocks too the pairs are those of all distances, once each, and no aggregation follows where ids are unique."""
    monkeypatch.setattr(V, "RUN", 70)
    rows = sample(300, 8, 9, spaces=("x", None))
    aggregates = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")
    d = distances(rows)
    once = V.near_pairs(V.build_index(spark.createDataFrame(rows, SCHEMA)), 0.2)
    assert sorted((x.a, x.b) for x in once.collect()) == [(i, j) for i in range(300) for j in range(i + 1, 300) if rows[i][1] == rows[j][1] and d[i, j] < 0.2]
    twice = V.near_pairs(V.build_index(spark.createDataFrame([*rows, rows[7]], SCHEMA)), 0.2)
    assert aggregates(twice) == aggregates(once) + 1
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
