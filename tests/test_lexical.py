"""The inverted index against a scan of every document."""

import random
import re
from collections import Counter

import pytest

from tessera.operators import lexical as L


def by_hand(docs, queries, k, every=False, allowed=None):
    out = {}
    for q in {x for x, _ in queries}:
        terms = {t for x, t in queries if x == q}
        scores = []
        for i, text in docs.items():
            n = Counter(re.findall("[a-z0-9]+", (text or "").lower()))
            found = [t for t in terms if n[t]]
            if found and (not every or len(found) == len(terms)) and (allowed is None or (q, i) in allowed):
                raw = round(sum(sum(1 / (j * j) for j in range(1, min(n[t], 255) + 1)) for t in found), 9)
                scores.append((-raw, i))
        out[q] = [i for _, i in sorted(scores)[:k]]
    return {q: v for q, v in out.items() if v}


@pytest.fixture
def made(spark, prose_of=None):
    r = random.Random(6)
    docs = {i: " ".join(f"w{min(r.randrange(60), r.randrange(60))}" + r.choice(["", ".", "-X", " "]) for _ in range(r.randrange(0, 60))) for i in range(300)}
    docs |= {900: None, 901: "", 902: "w1 " * 400, 903: "W1 w1"}
    queries = [(q, f"w{r.randrange(60)}") for q in range(12) for _ in range(r.randrange(1, 5))] + [(50, "unknown"), (51, "w1"), (51, "w1")]
    table = spark.createDataFrame(list(docs.items()), "id long, text string")
    return docs, queries, table, spark.createDataFrame(queries, "query long, term string")


def found(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query, r["rank"])):
        out.setdefault(r.query, []).append(r.id)
    return out


def test_any_and_all_terms_equal_a_scan(made):
    docs, queries, table, asked = made
    for size in (10, 5000):
        postings = L.build_postings(table, block_docs=size)
        assert found(L.search_postings(postings, asked, 7)) == by_hand(docs, queries, 7)
    assert found(L.search_postings(L.build_postings(table, block_docs=10), asked, 7, every=True)) == by_hand(docs, queries, 7, True)


def test_rows_left_out_before_the_best_are_taken(spark, made):
    docs, queries, table, asked = made
    allowed = {(q, i) for q in range(60) for i in docs if (q + i) % 3 == 0}
    rows = spark.createDataFrame(list(allowed), "query long, id long")
    postings = L.build_postings(table, asked, block_docs=20)
    got = found(L.search_postings(postings, asked, 5, keep=lambda x: x.join(rows, ["query", "id"], "left_semi")))
    assert got == by_hand(docs, queries, 5, allowed=allowed)


def test_scores_blocks_and_the_terms_asked_for(spark, made):
    docs, _, table, _ = made
    one = spark.createDataFrame([(1, "w1"), (1, "absent")], "query long, term string")
    postings = L.build_postings(table, one, block_docs=30)
    assert {r.term for r in postings.select("term").collect()} == {"w1"}
    assert all(max(p.weight for p in r.postings) == r.most for r in postings.collect())
    best = L.search_postings(postings, one, 1).first()
    assert best.id == 902 and abs(best.score - L.UNIT * sum(1 / j**2 for j in range(1, 256)) / 2) < 1e-9
    single = next(r for r in L.search_postings(postings, one, 400).collect() if len(re.findall(r"\bw1\b", (docs[r.id] or "").lower())) == 1)
    assert abs(single.score - 0.0304) < 1e-4  # one of two terms, once
    assert L.search_postings(L.build_postings(table.limit(0)), one, 3).count() == 0
