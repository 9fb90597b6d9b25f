"""Bounded clusters: each rule on its own, and all roots against a plain search from each."""

import random
from datetime import datetime, timedelta

import pytest

from tessera.operators.clusters import bounded_clusters

T0 = datetime(2026, 8, 1, 12)
DAY = timedelta(days=1)


def plain(items, seeds, links, memberships, edges, hops=3, most=50, days=30):
    """root -> (id -> (hop, reasons), truncated), one root after another."""
    out = {}
    for root in sorted({r for r, _ in seeds}):
        members = {i: (0, ["seed"]) for r, i in seeds if r == root and i in items}
        if not members:
            continue
        times, seen, cut, front = [items[i] for i in members if items[i]], set(), False, set(members)
        for hop in range(1, hops + 1):
            if not front or len(members) >= most:
                break
            new = {c for c, i in links if i in front} - seen
            seen |= new
            expanding = [m for m in memberships if m[3] == "active" and m[2] not in ("mentioned_only", "recurrence")]
            refs = {c for c, i, _, _ in expanding if i in front}
            found = {}
            for c, i in links:
                if c in new:
                    found.setdefault(i, set()).add(f"case:{c}")
            for c, i, rel, _ in expanding:
                if c in refs:
                    found.setdefault(i, set()).add(f"ticket_ref:{rel}")
            for a, b, kind in edges:
                for x, y in ((a, b), (b, a)):
                    if x in front and x != y:
                        found.setdefault(y, set()).add(f"correlation:{kind}")
            severed = {i for c, i, _, status in memberships if status == "negative" and c in seen | refs}
            front = set()
            for i in sorted(found):
                near = i in items and (items[i] is None or not times or min(abs(items[i] - t) for t in times) <= days * DAY)
                if i in members or i in severed or not near:
                    continue
                if len(members) >= most:
                    cut = True
                    break
                members[i] = (hop, sorted(found[i]))
                front.add(i)
        out[root] = (members, cut)
    return out


def run(spark, items, seeds, links=(), memberships=(), edges=(), **bounds):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    rows = bounded_clusters(
        frame(items.items(), "id long, at timestamp"), frame(seeds, "root long, id long"), frame(links, "case_id long, id long"),
        frame(memberships, "case_id long, id long, relationship string, status string"), frame(edges, "a long, b long, kind string"), **bounds,
    ).collect()
    out = {}
    for r in rows:
        members, _, names = out.setdefault(r.root, ({}, r.truncated, r))
        members[r.id] = (r.hop, list(r.reasons))
        assert (r.fingerprint, r.truncated) == (names.fingerprint, names.truncated)
    assert all(r.members == len(m) for m, _, r in out.values())
    return {k: (m, t) for k, (m, t, _) in out.items()}


def test_links_and_edges_make_one_cluster_of_several_sources(spark):
    got = run(spark, {1: T0, 2: T0 + timedelta(minutes=10), 3: T0}, [(9, 1)], [(7, 1), (7, 3)], [], [(1, 2, "case_link_match")])
    assert got == {9: ({1: (0, ["seed"]), 2: (1, ["correlation:case_link_match"]), 3: (1, ["case:7"])}, False)}


def test_fence_in_time(spark):
    edges = [(1, i, "x") for i in (2, 3, 4, 5, 6)]
    got = run(spark, {1: T0, 2: T0 - 90 * DAY, 3: None, 4: T0 + 30 * DAY, 5: T0 + 30 * DAY + timedelta(microseconds=1), 6: T0 - 30 * DAY}, [(1, 1)], edges=edges)
    assert set(got[1][0]) == {1, 3, 4, 6}
    undated = run(spark, {1: None, 2: T0 - 900 * DAY, 3: T0}, [(1, 1)], edges=edges)
    assert set(undated[1][0]) == {1, 2, 3}


def test_nearest_of_several_seeds_counts(spark):
    got = run(spark, {1: T0, 2: T0 + 200 * DAY, 3: T0 + 190 * DAY, 4: T0 + 100 * DAY}, [(1, 1), (1, 2)], edges=[(1, 3, "x"), (1, 4, "x")])
    assert set(got[1][0]) == {1, 2, 3}


@pytest.mark.parametrize("flood, cut", [(49, False), (50, True), (70, True)])
def test_size_and_its_mark(spark, flood, cut):
    items = {i: T0 for i in range(flood + 1)}
    got = run(spark, items, [(0, 0)], edges=[(0, i, "x") for i in range(1, flood + 1)], block=7)
    assert set(got[0][0]) == set(range(50)) and got[0][1] is cut


def test_mentions_and_recurrences_do_not_expand_and_negatives_stay_out(spark):
    items = {i: T0 for i in range(1, 8)}
    rows = [(5, 1, "primary", "active"), (5, 2, "related", "active"), (5, 3, "mentioned_only", "active"), (5, 4, "recurrence", "active"), (5, 6, "related", "negative"), (5, 7, "related", "pending")]
    got = run(spark, items, [(1, 1)], memberships=rows, edges=[(1, 6, "thread"), (2, 5, "thread")])
    assert got[1][0] == {1: (0, ["seed"]), 2: (1, ["ticket_ref:related"]), 5: (2, ["correlation:thread"])}


def test_invisible_rows_empty_tables_and_nulls(spark):
    assert run(spark, {2: T0}, [(1, 1), (None, 2)], edges=[(1, 2, "x")]) == {}
    assert run(spark, {}, []) == {}
    got = run(spark, {1: T0, 2: T0}, [(1, 1), (1, 1), (1, None)], [(None, 1), (None, 2)], [(None, 2, None, None)], [(1, None, "x"), (1, 1, "x"), (1, 2, None)])
    assert got == {1: ({1: (0, ["seed"]), 2: (1, ["correlation:"])}, False)}


@pytest.mark.parametrize("seed", [1, 2])
def test_all_roots_equal_a_search_from_each(spark, seed):
    rng = random.Random(seed)
    n = 160
    items = {i: None if rng.random() < 0.1 else T0 + rng.randrange(0, 150 * 24) * timedelta(hours=1) for i in range(n) if rng.random() < 0.95}
    hot = [(99, i) for i in range(n) if rng.random() < 0.5]
    links = hot + [(rng.randrange(30), rng.randrange(n)) for _ in range(60)]
    memberships = [(rng.choice([99, *range(30)]), rng.randrange(n), rng.choice(["primary", "related", "mentioned_only", "recurrence"]), rng.choice(["active", "active", "negative"])) for _ in range(90)]
    edges = [(rng.randrange(n), rng.randrange(n), rng.choice("ab")) for _ in range(40)]
    seeds = [(i, i) for i in range(n)] + [(1000 + k, rng.randrange(n)) for k in range(10) for _ in range(3)]
    bounds = {"most": 12, "window_days": 20}
    assert run(spark, items, seeds, links, memberships, edges, block=5, **bounds) == plain(items, seeds, links, memberships, edges, most=12, days=20)
