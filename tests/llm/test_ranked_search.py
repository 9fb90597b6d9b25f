import math
import random
import re
from collections import Counter

import numpy as np

from tessera.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in TERM.findall(text or "")]


def by_hand(docs, items, k):
    """Every item against every document, in whole numbers."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, query in wanted.items():
        scores = []
        for doc_id, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in query if t in c)
            if s > 0:
                scores.append((-s, doc_id is not None, doc_id or 0, doc_id))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def searched(docs, items, k=50):
    return sorted((tuple(r) for r in R.search(R.build_index(docs), items, k).collect()), key=repr)


def test_equals_every_item_against_every_document(spark, docs_of, prose, odd_rows, monkeypatch):
    r = random.Random(5)
    rows = [(100 + i, prose(i % 70, r.randrange(0, 90), 60), "en", "a") for i in range(240)] + odd_rows + [(7000, "Ünï e\u0301 x9-y9 K\u212a", "fr", "b")]
    docs = docs_of(rows).repartition(5)
    items = [(1, prose(3, 20, 60)), (2, "w1 W2 w3 w3"), (3, None), (4, "nothing known zzz"), (None, "one two ünï"), (2, "w9"), (5, "k \u212a e\u0301"), (6, ""), (7, "w5")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = by_hand([x[:2] for x in rows], items, 50)
    assert searched(docs, table) == want
    monkeypatch.setattr(R, "SHARD_TERMS", 300)
    monkeypatch.setattr(R, "QUERY_TERMS", 10)
    for k in (1, 7, 50):
        assert searched(docs, table, k) == by_hand([x[:2] for x in rows], items, k)


def test_ties_come_by_id_across_shards(spark, docs_of, monkeypatch):
    monkeypatch.setattr(R, "SHARD_TERMS", 8)
    rows = [(i, "same words here", "en", "a") for i in range(90)] + [(200, "other", "en", "a"), (3, "same words here", "en", "a")]
    random.Random(1).shuffle(rows)
    got = searched(docs_of(rows).repartition(6), spark.createDataFrame([(1, "same")], "item_id long, text string"), 10)
    assert sorted((x[1], x[2]) for x in got) == list(zip(range(1, 11), [0, 1, 2, 3, 3, 4, 5, 6, 7, 8], strict=True))


def test_empty_tables_and_ids_of_other_types(spark, docs_of):
    items = spark.createDataFrame([("q", "one")], "item_id string, text string")
    assert searched(docs_of([]), items) == []
    assert searched(docs_of([(1, None, None, None), (2, "-- !", None, None)]), items) == []
    assert searched(docs_of([(1, "one", None, None)]), items.limit(0)) == []
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one"), ("c", "three")], "doc_id string, text string")
    got = R.search(R.build_index(docs), items).orderBy("rank").collect()
    assert [x.doc_id for x in got] == [None, "a", "b"] and {x.item_id for x in got} == {"q"}


def test_selection_and_ratio():
    r = np.random.default_rng(3)
    for _ in range(200):
        scores = r.integers(0, 6, r.integers(0, 40))
        k = int(r.integers(1, 12))
        want = sorted((i for i in range(len(scores)) if scores[i] > 0), key=lambda i: (-scores[i], i))[:k]
        assert sorted(R.best(scores, k).tolist()) == sorted(want)
    big = np.array([3, 10**9], np.int64)
    assert R._ratio(big, 10**11, 7 * 10**12).tolist() == [50 + 50 * int(n) * 10**11 // (7 * 10**12) for n in big]
