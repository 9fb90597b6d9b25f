"""Held-out accuracy on small made-up corpora, and defined answers for odd rows."""

import random
import zlib

import pytest

import tessera.llm.quality as Q
import tessera.llm.toxicity as X
from tessera.llm.common import held_out
from tessera.llm.language import UNKNOWN, family, fit_languages, identify_language


def corpus(prose, n=400):
    r, rows, labels = random.Random(6), [], []
    for i in range(n):
        toxic, good = i % 5 == 0, i % 3 != 0
        words = prose(i, r.randrange(40, 120)).split()
        if toxic:
            at = r.randrange(len(words))
            words[at:at] = [r.choice(["grubbo", "zlonk", "fnarg", "mumble"]) for _ in range(6)]
        if not good:
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words), "en", "a"))
        if i % 10 != 9:
            labels.append((i, int(good), int(toxic)))
    return rows, labels


@pytest.fixture
def learned(spark, docs_of, prose, odd_rows):
    rows, labels = corpus(prose)
    extra = [(None if i is None else 1000 + i, t, lang, s) for i, t, lang, s in odd_rows]
    return docs_of([*rows, *extra]), spark.createDataFrame([*labels, (None, 1, 1), (1001, None, None)], "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


def is_held_out(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0


def test_toxicity_on_held_out_documents(learned):
    docs, labels, truth = learned
    scored = X.score_toxicity(docs, X.fit_toxicity(docs, labels))
    rows = scored.select("doc_id", held_out().alias("h"), "toxicity", "toxic_passages").collect()
    assert len(rows) == docs.count() and all(0 <= r.toxicity <= 1 and r.h == is_held_out(r.doc_id) for r in rows)
    held = [r for r in rows if r.h and r.doc_id in truth]
    assert sum((r.toxicity >= 0.5) == bool(truth[r.doc_id][1]) for r in held) >= 0.95 * len(held)
    passage = next(r for r in rows if r.doc_id == 5).toxic_passages
    assert len(passage) == 1 and 6 <= passage[0].end - passage[0].start <= 8
    null, empty = (next(r for r in rows if r.doc_id == i) for i in (1001, 1002))
    assert null.toxicity == empty.toxicity < 0.5 and null.toxic_passages == []


def test_maximal_segments_agree_with_recursion():
    import numpy as np

    def recursive(x, a, b):
        """The best segment, first and shortest of equals, then left and right of it."""
        best = max(((sum(x[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best is None or best[0] <= 1e-12:
            return []
        return recursive(x, a, best[3]) + [(best[3], best[4])] + recursive(x, best[4], b)

    r = random.Random(1)
    for _ in range(300):
        scores = np.array([r.choice((0, 0, 0, 1.25, 2.5)) for _ in range(r.randrange(0, 14))])
        cost = r.choice((0.375, 1.0, 2.0))
        full = [s if s > 0 else -cost for s in scores]
        assert [s[:2] for s in X.maximal_segments(scores, cost)] == recursive(full, 0, len(full)), (scores, cost)


def test_quality_on_held_out_documents(learned):
    docs, labels, truth = learned
    rows = Q.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.held_out == is_held_out(r.doc_id) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id][0] for r in held) >= 0.95 * len(held)


def test_no_label_or_one_class(spark, docs_of, prose):
    docs = docs_of([(i, prose(i, 20), "en", "a") for i in range(10)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    assert {r.score for r in Q.quality_scores(docs, none).collect()} == {0.5}
    assert all(r.score > 0.5 for r in Q.quality_scores(docs, one).collect())
    for labels in (none, one):
        assert all(r.toxicity < 0.5 for r in X.score_toxicity(docs, X.fit_toxicity(docs, labels)).collect())
    empty = docs_of([])
    assert Q.quality_scores(empty, one).count() == 0 and X.score_toxicity(empty, X.fit_toxicity(empty, one)).count() == 0


SYLLABLES = {"en": "th er on ing and ly wh", "de": "sch en ung ver keit ö ach", "fr": "eau ou ère tion é qu ai", "es": "ción ñ que os ja ue dor", "xx": "zq kx vv yy jj ww qq"}


def sentence(lang, r):
    s = SYLLABLES[lang].split()
    return " ".join("".join(r.choice(s) for _ in range(r.randrange(1, 4))) for _ in range(25))


def test_language_on_held_out_documents(docs_of, odd_rows):
    r = random.Random(3)
    rows = [(i, sentence(lang, r), lang, "a") for i in range(300) for lang in [r.choice(list(SYLLABLES))]]
    odd = [(None if i is None else 1000 + i, t, None, s) for i, t, _, s in odd_rows] + [(2000, "123 456 --", "en", "a")]
    docs = docs_of([*rows, *odd])
    found = {x.doc_id: (x.lang_pred, x.lang_score) for x in identify_language(docs, fit_languages(docs)).collect()}
    held = [(i, lang) for i, _, lang, _ in rows if is_held_out(i)]
    assert sum(found[i][0] == lang for i, lang in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for _, s in found.values())
    assert found[1001] == found[1002] == found[2000] == (UNKNOWN, 0.0)
    assert family("xx") != family("en") == family("de-AT")


def test_language_without_anything_to_learn(docs_of):
    docs = docs_of([(1, "some text", None, "a")])
    assert fit_languages(docs) is None
    assert identify_language(docs, None).collect()[0].lang_pred == UNKNOWN
    assert identify_language(docs_of([]), None).count() == 0


def test_maximal_segments_take_linear_time():
    """Positives that come ever lower, so that none has an earlier one below it, and positives that merge."""
    import time

    import numpy as np

    def seconds(n, every):
        x = np.zeros(n)
        x[::every] = 1.0
        began = time.perf_counter()
        found = X.maximal_segments(x, 0.35)
        assert found and sum(b - a for a, b, _ in found) <= n
        return time.perf_counter() - began

    for every in (2, 10):
        seconds(100_000, every)
        assert seconds(1_000_000, every) < 15 * max(0.05, seconds(250_000, every))


def test_negative_evidence_ends_a_segment():
    import numpy as np

    assert [(a, b) for a, b, _ in X.maximal_segments(np.array([2.0, 0, 2.0]), 0.3)] == [(0, 3)]
    assert [(a, b) for a, b, _ in X.maximal_segments(np.array([2.0, -3.0, 2.0]), 0.3)] == [(0, 1), (2, 3)]
    # As common in both classes: nothing; much rarer in toxic text: below 0.
    odds = X.Counts(np.arange(3), np.array([50.0, 400.0, 1.0]), np.array([50.0, 1.0, 400.0]), 5000.0, 5000.0).odds()
    assert odds[0] == 0 and odds[1] > 1 and odds[2] < -1


def test_a_hot_id_in_the_labelled_rows_brings_one_row(spark, prose):
    """Rows that repeat a drawn id don't reach the driver."""
    from tessera.llm.common import one_text_each

    docs = spark.range(20_000).selectExpr("7L doc_id", "concat('text ', id % 900) text").union(spark.createDataFrame([(8, "other"), (9, None)], "doc_id long, text string"))
    chosen = spark.createDataFrame([(7, 1, 0), (9, 0, 1)], "doc_id long, y int, half int")
    got = one_text_each(docs, chosen).collect()
    assert sorted((r.doc_id, r.y, r.half) for r in got) == [(7, 1, 0), (9, 0, 1)]
    assert one_text_each(docs.repartition(3), chosen).where("doc_id = 7").first().text == next(r.text for r in got if r.doc_id == 7)


def test_language_fit_counts_equal_rows_once_and_bounds_a_hot_id(docs_of, prose):
    from tessera.llm import language as L

    rows = [(7, "the same english words", "en", "a")] * 3000 + [(8, f"le texte fran\u00e7ais num\u00e9ro {i}", "fr", "a") for i in range(3000)]
    known = docs_of(rows).where("lang is not null").selectExpr("doc_id", "lang", "text", "xxhash64(doc_id, text) draw")
    drawn, _ = L.bounded_sample(known, "lang", "draw", 100)
    got = {r.lang: r["count"] for r in drawn.dropDuplicates(["doc_id", "lang", "draw"]).groupBy("lang").count().collect()}
    assert got.get("en", 0) <= 1 and 50 <= got["fr"] <= 170


def test_letters_are_those_of_the_unicode_category():
    from tessera.llm.language import has_letter

    assert not any(map(has_letter, ("", "12 \u00bd \u00b2 \u2460 _-", "\u0301", "\u2160")))
    assert all(map(has_letter, ("a", "1\u00e9", "\u4e2d", "\u02b0", "\u01c5")))


def test_hinge_fit_agrees_with_a_dense_solver():
    """Dual coordinate descent against projected gradient steps on the same dual."""
    import numpy as np

    from tessera.llm.linear import fit_hinge

    r = np.random.default_rng(4)
    x = r.normal(size=(40, 3))
    y = np.where(x @ np.array([1.0, -2.0, 0.5]) + 0.3 * r.normal(size=40) > 0.2, 1, -1)
    at = slice(0, 3)
    w = fit_hinge([(at, row) for row in x], y, 3, cost=1.0, passes=400)
    z = np.column_stack([x, np.ones(40)]) * y[:, None]
    q, alpha = z @ z.T, np.zeros(40)
    step = 1 / np.linalg.eigvalsh(q).max()
    for _ in range(40_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, 1.0)
    assert np.allclose(w, z.T @ alpha, atol=2e-2)
