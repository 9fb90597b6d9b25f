import random

import numpy as np
import pyarrow as pa

import tessera.llm.decontaminate as D
from tessera.llm import words as W


def brute_tiles(a, b, least):
    """Greedy string tiling by looking at every pair of places."""
    used_a, used_b, tiles = [False] * len(a), [False] * len(b), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return tiles
        tiles.append(best)
        for k in range(best[2]):
            used_a[best[0] + k] = used_b[best[1] + k] = True


def test_tiles_agree_with_all_places():
    r = random.Random(4)
    for _ in range(150):
        a = [r.randrange(4) for _ in range(r.randrange(1, 25))]
        b = [r.randrange(4) for _ in range(r.randrange(1, 40))]
        least = 3
        seeds = [(i, j) for i in range(len(a) - least + 1) for j in range(len(b) - least + 1) if a[i : i + least] == b[j : j + least]]
        p, t = (np.array([s[k] for s in seeds], np.int64) for k in (0, 1))
        places = [(i, t[p == i]) for i in np.unique(p).tolist()]
        runs = D.runs_of_pairs(p, t)
        assert sorted(runs.tolist()) == sorted(D.runs_by_place(places, len(b)).tolist())
        assert D.tile_runs(runs, least) == brute_tiles(a, b, least)


def test_long_repetitive_texts(spark, docs_of, monkeypatch):
    """20,000 equal words against 5,000 in memory of the words, and by both ways the same."""
    items = D.Items.of([1, 2], pa.array(["ha " * 5000, "ha ho " * 40]))
    words = next(W.tokens(pa.array(["ha " * 20_000]), D._LETTERS))[2]
    assert items.found(words) == [[{"item": 1, "coverage": 1.0, "tiles": 1, "longest": 5000}]]
    other = next(W.tokens(pa.array(["x ha ho ha ho ha ho ha ho y " * 9]), D._LETTERS))[2]
    first = items.found(other)
    monkeypatch.setattr(D, "PAIRS_AT_ONCE", 0)
    assert items.found(other) == first and first[0][0]["item"] == 2


def test_short_items_are_found_whole(spark, docs_of):
    bench = spark.createDataFrame([("a", "two words"), ("b", "not here now"), ("c", ""), ("a", "two words")], "item_id string, text string")
    docs = docs_of([(1, "here are Two, words indeed", "en", "a"), (2, "two other words", "en", "a"), (3, None, "en", "a")])
    found = {r.doc_id: [(x.item, x.coverage) for x in r.leaks] for r in D.find_leaks(docs, bench).collect()}
    assert found == {1: [("a", 1.0), ("a", 1.0)], 2: [], 3: []}


def test_reordered_passages_are_found_and_clean_ones_are_not(spark, docs_of, prose, odd_rows):
    item = prose(1, 40)
    w = item.split()
    reordered = " ".join([*w[20:], "and", *w[:20]])
    docs = docs_of([*odd_rows, (20, prose(2, 300) + " " + item.upper() + ". " + prose(3, 50), "en", "a"), (21, reordered, "en", "a"), (22, " ".join(w[:12]), "en", "a"), (23, prose(7, 500), "en", "a")])
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, prose(8, 30)), (5, "")], "item_id long, text string")
    found = {r.doc_id: r.leaks for r in D.find_leaks(docs, bench).collect()}
    assert {i for i, leaks in found.items() if leaks} == {20, 21}
    assert found[20][0].item == 1 and found[20][0].coverage == 1.0 and found[20][0].tiles == 1
    assert found[21][0].tiles == 2 and found[21][0].longest == 20


def test_blocks_of_the_benchmark(spark, docs_of, prose, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 50)
    bench = spark.createDataFrame([(i, prose(i, 30)) for i in range(7)], "item_id long, text string")
    docs = docs_of([(i, prose(i, 30) + " tail", "en", "a") for i in range(9)])
    assert {r.doc_id: [x.item for x in r.leaks] for r in D.find_leaks(docs, bench).collect()} == {i: [i] if i < 7 else [] for i in range(9)}


def test_empty_tables(spark, docs_of):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.leaks for r in D.find_leaks(docs_of([(1, "a b c d e f", "en", "a")]), bench).collect()] == [[]]
    assert D.find_leaks(docs_of([]), bench).count() == 0
