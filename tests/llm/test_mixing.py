import random
import re

from tessera.llm.mixing import WEIGHTS, mix_sources, source_targets


def targets_by_loop(sizes):
    """Share by weight; what is above three times its source goes round again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, free, rest = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not full:
            target.update({s: level * weight[s] for s in free})
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
        free -= full
    return target


def test_targets_agree_with_resharing(spark):
    r = random.Random(2)
    for _ in range(12):
        sizes = {s: r.choice((0, 1, 5, 100, 1000, 20000)) for s in r.sample(["a", "b", "B", "é", "z", "src10", "src2", None], r.randrange(1, 8))}
        sized = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {x.source: x.target for x in source_targets(sized).collect()}
        want = targets_by_loop(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want), (sizes, got, want)


def test_mix_comes_near_its_targets_and_is_repeatable(docs_of, prose):
    r = random.Random(8)
    rows = [(i, prose(i, r.randrange(1, 60)), "en", r.choice(["a", "a", "a", "b", "c", "d"])) for i in range(1500)]
    docs = docs_of(rows)
    mixed = mix_sources(docs, fan_in=6).collect()
    assert len(mixed) == len(rows)
    again = {x.doc_id: x.taken for x in mix_sources(docs.repartition(7), fan_in=6).collect()}
    assert {x.doc_id: x.taken for x in mixed} == again
    for s in "abcd":
        own = [x for x in mixed if x.source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 0.02 * own[0].target + 60
    assert all(x.taken == x.copies * x.size and 0 <= x.copies <= 3 for x in mixed)


def test_sizes_and_odd_rows(docs_of, odd_rows):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in odd_rows}
    mixed = mix_sources(docs_of(odd_rows)).collect()
    assert len(mixed) == len(odd_rows)
    assert all(x.size == size[x.doc_id] for x in mixed)
    assert all(x.taken <= 3 * x.size for x in mixed)
    assert mix_sources(docs_of([])).count() == 0
    assert mix_sources(docs_of([(1, None, None, None)])).collect()[0].taken == 0


def test_null_and_repeated_ids_are_dealt_evenly(docs_of, prose):
    """As many blocks as with distinct ids, and the source's words near its target."""
    rows = [(None if i % 2 else 5, prose(i % 7, 3 + i % 7), "en", "a" if i % 3 else "b") for i in range(6000)]
    mixed = mix_sources(docs_of(rows))
    first = sorted(map(str, mixed.collect()))
    assert len(first) == 6000 and first == sorted(map(str, mix_sources(docs_of(rows[::-1]).repartition(3)).collect()))
    for r in mixed.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 0.02 * r["max(target)"] + 10
