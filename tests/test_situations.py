"""Which signals become one situation, and which must not."""

import random
from datetime import datetime, timedelta

from tessera.operators.situations import correlate, hub_items, situation_changes

T0 = datetime(2024, 5, 1, 2)


def found(spark, signals, links=()):
    """``signals``: id -> (hours or None, items, symptoms, environment)."""
    rows = [(i, None if h is None else T0 + timedelta(hours=h), e) for i, (h, _, _, e) in signals.items()]
    items = [(i, x) for i, s in signals.items() for x in s[1]]
    symptoms = [(i, x) for i, s in signals.items() for x in s[2]]
    return correlate(
        spark.createDataFrame(rows, "id long, at timestamp, environment string"), spark.createDataFrame(items, "id long, item string"),
        spark.createDataFrame(symptoms, "id long, signature string"), spark.createDataFrame(list(links), "a long, b long, kind string"),
    )


def groups(spark, signals, links=()):
    out = {}
    for r in found(spark, signals, links).collect():
        out.setdefault(r.situation, set()).add(r.id)
    return sorted(map(sorted, out.values()))


def test_item_window_and_symptom_are_all_needed(spark):
    base = (0, ["dc"], ["dns"], None)
    for other, merges in (
        ((0.75, ["dc"], ["dns"], None), True),
        ((0.5, ["dc"], ["disk"], None), False),
        ((24 * 21, ["dc"], ["dns"], None), False),
        ((0.2, ["web"], ["dns"], None), False),
        ((None, ["dc"], ["dns"], None), False),
        ((24, ["dc"], ["dns"], None), True),
        ((24.01, ["dc"], ["dns"], None), False),
    ):
        assert groups(spark, {1: base, 2: other}) == ([[1, 2]] if merges else []), other


def test_environments_that_differ_veto_and_unknown_ones_do_not(spark):
    at = lambda e: (0, ["dc"], ["dns"], e)
    assert groups(spark, {1: at("prod"), 2: at("staging")}) == []
    assert groups(spark, {1: at("prod"), 2: at(None)}) == [[1, 2]]
    assert groups(spark, {1: at("prod"), 2: at("prod")}) == [[1, 2]]


def test_links_of_people_merge_and_shared_problems_do_not(spark):
    alone = lambda h: (h, [], [], None)
    storm = {i: alone(i * 300) for i in range(1, 7)}
    rows = found(spark, storm, [(i, 1, "child_of_incident") for i in range(2, 7)]).collect()
    assert {r.id for r in rows} == set(range(1, 7)) and {r.situation for r in rows} == {1}
    assert {(r.kind, r.state, r.method, r.status, r.confidence) for r in rows} == {("incident_storm", "active", "authoritative", "confirmed", 0.95)}
    assert [r.id for r in rows if r.role == "primary_incident"] == [1]
    assert groups(spark, storm, [(2, 1, "related_problem"), (3, 1, "affects_ci"), (4, 99, "duplicate_of"), (5, 5, "duplicate_of")]) == []


def test_a_hub_anchors_nothing(spark):
    eight = {i: (0, ["dc"], ["dns"], None) for i in range(8)}
    assert groups(spark, eight) == [list(range(8))]
    nine = eight | {8: (0, ["dc"], ["dns"], None)}
    assert groups(spark, nine) == []
    assert groups(spark, nine | {0: (0, ["dc", "web"], ["dns"], None), 1: (0, ["dc", "web"], ["dns"], None)}) == [[0, 1]]
    items = spark.createDataFrame([(i % 9, "dc") for i in range(90)] + [(i % 8, "web") for i in range(90)], "id long, item string")
    assert [r.item for r in hub_items(items).collect()] == ["dc"]


def test_inferred_members_chain_beyond_the_window_and_say_so(spark):
    rows = found(spark, {i: (20 * i, ["dc"], ["dns"], None) for i in range(3)} | {7: (200, [], [], None)}, [(7, 2, "duplicate_of")]).collect()
    assert {r.id: r.method for r in rows} == {0: "inferred", 1: "inferred", 2: "authoritative", 7: "authoritative"}
    assert {(r.kind, r.state, r.members, r.onset, r.last_signal) for r in rows} == {("degradation", "active", 4, T0, T0 + timedelta(hours=200))}
    weak = found(spark, {i: (i, ["dc"], ["dns"], None) for i in range(2)}).collect()
    assert {(r.kind, r.state, r.confidence, r.situation_confidence) for r in weak} == {("unknown", "emerging", 0.5, 0.5)}


def test_equals_union_find_over_all_pairs(spark):
    r = random.Random(3)
    signals = {i: (None if r.random() < 0.05 else r.random() * 300, r.sample("abcdefghijklmnopqrstuvwxyz", 2), r.sample("uvwxyz", r.randrange(3)), r.choice(["p", "s", None])) for i in range(90)}
    links = [(r.randrange(90), r.randrange(95), r.choice(["child_of_incident", "duplicate_of", "related_problem"])) for _ in range(25)]
    parent = {i: i for i in signals}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    degree = {x: sum(x in s[1] for s in signals.values()) for s in signals.values() for x in s[1]}
    for a, b, kind in links:
        if kind != "related_problem" and a in signals and b in signals:
            parent[root(b)] = root(a)
    for a, (h, items, symptoms, env) in signals.items():
        for b, (g, others, more, place) in signals.items():
            if a < b and h is not None and g is not None and abs(h - g) <= 24 and set(symptoms) & set(more) and not (env and place and env != place) and any(degree[x] <= 8 for x in set(items) & set(others)):
                parent[root(b)] = root(a)
    want = {}
    for i in signals:
        want.setdefault(root(i), []).append(i)
    assert groups(spark, signals, links) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_a_run_over_stored_situations(spark):
    rows = found(spark, {i: (i, ["dc"], ["dns"], None) for i in range(3)} | {10: (0, ["a"], ["x"], None), 11: (0, ["a"], ["x"], None), 20: (0, ["b"], ["x"], None), 21: (0, ["b"], ["x"], None)})
    own = rows.where("id = 20").first().fingerprint
    stored = [("S1", 0, T0, "old"), ("S1", 1, T0, "old"), ("S0", 2, T0 - timedelta(hours=1), "older"), ("S3", 20, T0, own), ("S3", 21, T0, own)]
    got = {r.situation: (r.stored, r.action, r.new_members) for r in situation_changes(rows, spark.createDataFrame(stored, "stored string, id long, onset timestamp, fingerprint string")).collect()}
    assert got == {0: ("S0", "extend", 2), 10: (None, "create", 2), 20: ("S3", "keep", 0)}


def test_the_fingerprint_names_a_set(spark):
    at = (0, ["dc"], ["dns"], None)
    name = lambda ids: found(spark, {i: at for i in ids}).first().fingerprint
    assert name([1, 2, 3]) == name([3, 1, 2]) != name([1, 2])
    assert found(spark, {}).count() == 0
