import random
import re
from collections import Counter, defaultdict

import tessera.llm.jaccard as J

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    parent = {i: i for i, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    sets, index = [(i, shingles(t)) for i, t in rows], defaultdict(list)
    for k, (i, s) in enumerate(sets):
        common = Counter()
        for x in s:
            common.update(index[x])
            index[x].append(k)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                a, b = find(i), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def got(docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(docs).collect()}


def near_copies(prose, seed):
    """Groups with from none to many edits, chains of edits, a passage that all share, copies in another case."""
    r, rows = random.Random(seed), []
    passage = prose(seed + 1000, 60)
    for g in range(25):
        words = prose(seed * 100 + g, r.choice((3, 8, 30, 120, 400))).split()
        for _ in range(r.randrange(1, 6)):
            for _ in range(r.randrange(0, max(1, len(words) // 25) + 1)):
                words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
            text = " ".join(words)
            rows.append(text.upper() if r.random() < 0.1 else text + (" " + passage if r.random() < 0.4 else ""))
    r.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


def test_components_agree_with_all_pairs(docs_of, prose):
    for seed in (1, 2):
        rows = near_copies(prose, seed)
        assert got(docs_of([(i, t, "en", "a") for i, t in rows])) == brute(rows)


def test_long_lists_are_compared_block_by_block(docs_of, prose, monkeypatch):
    monkeypatch.setattr(J, "LIST_BLOCK", 3)
    monkeypatch.setattr(J, "PROBES", 1)
    rows = near_copies(prose, 5)
    assert got(docs_of([(i, t, "en", "a") for i, t in rows])) == brute(rows)


def test_hot_shingles_take_the_salted_way(docs_of, prose, monkeypatch):
    """One passage in every set, with lists over many blocks, ranges and batches."""
    for name, value in (("LIST_BLOCK", 4), ("HOT_LEAST", 3), ("HOT_MEANS", 0), ("RANGE_ENTRIES", 50), ("PACK_ENTRIES", 300), ("PROBES", 1)):
        monkeypatch.setattr(J, name, value)
    rows = [(i, t + " " + prose(77, 40)) for i, t in near_copies(prose, 9)]
    assert got(docs_of([(i, t, "en", "a") for i, t in rows]).repartition(5)) == brute(rows)
    monkeypatch.setattr(J, "HOT_LEAST", 10**9)  # all by the streaming way
    assert got(docs_of([(i, t, "en", "a") for i, t in rows]).repartition(5)) == brute(rows)


def test_members_are_answered_through_representatives(docs_of, monkeypatch):
    """Two groups of similar sets that only some members of each tie together."""
    monkeypatch.setattr(J, "PROBES", 1)
    r, rows = random.Random(3), []
    for base in range(6):
        words = [f"b{base}x{k}" for k in range(120)]
        for k in range(8):
            other = list(words)
            for x in range(r.randrange(0, 5)):
                other[r.randrange(len(other))] = f"e{base}{k}{x}"
            cut = r.randrange(0, 9) * 2
            rows.append(" ".join(other[: 120 - cut] + [f"b{base + 1}y{j}" for j in range(cut)]))
    rows = list(enumerate(rows))
    assert got(docs_of([(i, t, "en", "a") for i, t in rows])) == brute(rows)


def test_every_text_of_a_repeated_id_is_compared(docs_of, prose):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, a), (1, b), (5, a + " x"), (7, b + " y"), (9, prose(3, 60)), (9, "")]
    for order in (rows, rows[::-1]):
        found = {(r.doc_id, r.component_id) for r in J.jaccard_components(docs_of([(i, t, "en", "a") for i, t in order])).collect()}
        assert found == {(1, 1), (5, 1), (7, 1), (9, 9)}


def test_ids_may_be_strings(spark, prose):
    text = prose(1, 60)
    docs = spark.createDataFrame([("b", text), ("a", text + " x"), ("c", None), ("d", prose(4, 50))], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in J.jaccard_components(docs).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d"}
    assert sorted(r.doc_id for r in J.near_duplicate_representatives(docs).collect()) == ["a", "c", "d"]


def test_many_rows_of_one_id(docs_of, prose):
    text = prose(1, 40)
    rows = [(3, text)] * 3000 + [(None, text)] * 3000 + [(4, text + " z")]
    found = J.jaccard_components(docs_of([(i, t, "en", "a") for i, t in rows])).groupBy("doc_id", "component_id").count().collect()
    assert {(r.doc_id, r.component_id, r["count"]) for r in found} == {(3, 3, 3000), (4, 3, 1), (None, None, 3000)}


def test_odd_rows(docs_of, odd_rows):
    rows = got(docs_of([x for x in odd_rows if x[0] is not None]))
    assert rows[1] == (0, 1) and rows[2] == (0, 2) and rows[3] == (0, 3)
    assert rows[5][1] == 4 and rows[7] == (1, 6) and rows[6] == (1, 6)
    assert J.jaccard_components(docs_of(odd_rows)).count() == len(odd_rows)
    assert got(docs_of([])) == {}


def test_one_of_each_group_stays(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    kept = J.near_duplicate_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 6, 8, None], key=str)


def test_parity_is_a_lower_bound():
    import numpy as np

    r = np.random.Generator(np.random.PCG64(1))
    a = np.unique(r.integers(0, 2**63, 700, dtype=np.uint64))
    b = np.unique(np.concatenate((a[:600], r.integers(0, 2**63, 50, dtype=np.uint64))))
    apart = len(np.setxor1d(a, b))
    for x, y in ((1024, 1024), (4096, 1024)):
        assert J.odd_buckets(J.parity_bits(a, x), J.parity_bits(b, y)) <= apart


def test_many_components_give_a_forest_and_not_all_their_pairs(docs_of, prose, monkeypatch):
    monkeypatch.setattr(J, "LEAD_TASKS", 1)
    words, rows = prose(4, 200).split(), []
    for k in range(40):
        other = list(words)
        other[5 * k] = f"new{k}"
        rows.append((k, " ".join(other), "en", "a"))
    docs = docs_of(rows).select("doc_id", "text")
    sets = J.numbered_sets(J.profiles(docs))
    apart = sets.selectExpr("sid AS id", "sid AS comp")
    names = sets.selectExpr(f"lo & {(1 << J.NAME_BITS) - 1} AS name", "sid", "n", "sid AS comp")
    entries = J._index(docs, J.shingle_order(docs), 1).join(names, "name").select("token", "sid", "comp", "n", "pos")
    blocks = J._blocks(entries)
    assert J._list_pairs(blocks, apart, sets, best=False).count() == 40 * 39 // 2
    pairs = J._list_pairs(blocks, apart, sets, best=True)
    assert 39 <= pairs.count() < 200
    assert J.components(apart.select("id"), pairs).select("comp").distinct().count() == 1


def test_forest_takes_the_nearest_pairs():
    import numpy as np

    rows = np.array([[5, 1, 2, 10, 20], [1, 2, 3, 20, 30], [9, 1, 3, 10, 30], [2, 1, 2, 11, 20], [7, 8, 9, 80, 90]])
    assert J._forest(rows).tolist() == [[1, 2, 3, 20, 30], [2, 1, 2, 11, 20], [7, 8, 9, 80, 90]]
    assert len(J._forest(rows[:0])) == 0


def test_small_tables_are_held_in_few_partitions(spark):
    from tessera.llm.common import FEW_PARTITIONS, HELD_ROWS, held

    for rows, parts in ((50, 1), (3 * HELD_ROWS, 3), (HELD_ROWS * 100, 64)):
        out = held(spark.range(0, rows, 1, 64))
        assert out.rdd.getNumPartitions() == parts and out.agg({"id": "sum"}).first()[0] == rows * (rows - 1) // 2
    assert held(spark.range(0, 5, 1, FEW_PARTITIONS)).rdd.getNumPartitions() == FEW_PARTITIONS
