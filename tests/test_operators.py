"""Operators against brute force on small random inputs."""

import random

from tessera.operators.dedup import contained_sets
from tessera.operators.graph import ancestor_chains, decay_expand
from tessera.operators.references import heal, newest, resolve
from tessera.operators.selection import select_connected


def test_contained_sets(spark):
    r = random.Random(5)
    sets = {i: frozenset(r.sample(range(12), r.randrange(1, 7))) for i in range(80)}
    want = {i for i, s in sets.items() if any(s < t or (s == t and j < i) for j, t in sets.items() if j != i)}
    rows = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s] * 2, "id long, item long")
    assert {x.id for x in contained_sets(rows).collect()} == want
    assert contained_sets(rows.limit(0)).count() == 0


def test_chains(spark):
    parents = {1: None, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6, 9: 8, 10: 11, 11: 10}
    got = {x.node: x.chain for x in ancestor_chains(spark.createDataFrame(list(parents.items()), "node long, parent long")).collect()}
    assert got[7] == list("1234567") and got[1] == ["1"] and got[9] == ["9"]
    assert len(got) == len(parents) and got[10][-1] == "10"


def test_decay_keeps_the_best_way(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 0.4), (3, 4, 1.0)], "src long, dst long, weight double")
    seeds = spark.createDataFrame([(1, 1.0)], "node long, score double")
    got = {x.node: (round(x.score, 4), x.parent) for x in decay_expand(edges, seeds, 3).collect()}
    assert got == {1: (1.0, None), 2: (0.72, 1), 3: (0.5184, 2), 4: (0.3732, 3)}


def test_references_heal(spark):
    refs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "case long, name string")
    records = newest(spark.createDataFrame([("a", 1, 10), ("a", 2, 11), ("b", 1, 20)], "name string, version long, target long"), "name", ["version", "target"])
    first = resolve(refs, records.where("name = 'a'"), "name")
    assert {(x.case, x.target, x.state) for x in first.collect()} == {(1, 11, "resolved"), (2, None, "unresolved"), (3, None, "unresolved")}
    assert {(x.case, x.target, x.state) for x in heal(first, records, "name").collect()} == {(1, 11, "resolved"), (2, 20, "healed"), (3, None, "unresolved")}


def test_connected_selection(spark):
    """Every chosen node has its way to the root, budgets hold, and a plain greedy walk chooses the same."""
    r = random.Random(7)
    rows = []
    for case in range(6):
        for k in range(40):
            parent = None if k == 0 else f"n{r.randrange(k)}"
            rows.append((case, f"n{k}", parent, r.choice("abc"), round(r.random(), 3), r.randrange(5, 30)))
    most_nodes, most_chars = 12, 200
    got = select_connected(spark.createDataFrame(rows, "case long, node string, parent string, type string, score double, chars int"), most_nodes, most_chars, {"b": 2}, True).collect()
    for case in range(6):
        mine = {x[1]: x for x in rows if x[0] == case}
        order = sorted(mine, key=lambda n: (-mine[n][4], mine[n][3], n))
        chosen, used, stop = [], 0, False
        for n in [x for x in order if mine[x][3] == "b"][:2] + order:
            way = [n]
            while mine[way[0]][2]:
                way.insert(0, mine[way[0]][2])
            way = [x for x in way if x not in chosen]
            size = sum(mine[x][5] for x in way)
            if stop or not way or len(chosen) + len(way) > most_nodes:
                continue
            if used + size > most_chars - most_chars // 10:
                stop = True
                continue
            chosen += way
            used += size
        picked = sorted((x for x in got if x.case == case), key=lambda x: x.place)
        assert [x.node for x in picked] == chosen and all(x.chars_used == used for x in picked)
