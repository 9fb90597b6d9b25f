import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm.fill_middle import SENTINELS, fill_in_middle, restored_text, unit_ends, windows


def by_hand(doc_id, text, rate=100, units=r"[^\n]*\n|[^\n]+"):
    """The rule, word for word."""
    text = text or ""
    lines = re.findall(units, text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(lines)
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    form = "spm" if h4 % 100 < 50 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def transformed(docs, **options):
    done = fill_in_middle(docs, **options)
    return done.withColumn("back", restored_text(F.col("output"), F.col("form"))).collect()


def test_equals_the_rule_and_gives_the_text_back(docs_of, prose):
    texts = [f"{prose(k, k)}\n{'é😀' * (k % 5)}\n\n{prose(k + 1, 3)}" + "\n" * (k % 3) for k in range(60)]
    texts += ["a\r\nb\r\nc", "\n", "x", "a <P> b\nc", "<S", "<\n<S\nP>\n<M", "$1 \\E \\Q\n\\n", "tail<"]
    rows = transformed(docs_of([(k, t, "en", "a") for k, t in enumerate(texts)]))
    assert {x.form for x in rows} == {"plain", "psm", "spm"}
    for x in rows:
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == by_hand(x.doc_id, texts[x.doc_id])
        assert x.back == texts[x.doc_id]


def test_odd_rows_and_a_rate(docs_of, odd_rows):
    docs = docs_of(odd_rows).withColumn("form", F.lit("old"))
    for rate in (100, 40):
        rows = transformed(docs, rate=rate)
        assert len(rows) == len(odd_rows)
        for x in rows:
            assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == by_hand(x.doc_id, x.text, rate)
            assert x.back == (x.text or "") and x.comp == "x"
    assert fill_in_middle(docs_of([])).count() == 0


def test_windows_do_not_change_the_units():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    splitter = Split(Regex(r"[^\n]*\n|[^\n]+"), behavior="isolated")
    for text in ("", "\n", "a\nbb\n\nccc", "x" * 50 + "\n" + "y" * 3, "é\n" * 40, "a\n" + "z" * 60):
        want = [m.end() for m in re.finditer(r"[^\n]*\n|[^\n]+", text)]
        for size in (1, 2, 7, 1000):
            assert unit_ends(splitter, text, "\n", size).tolist() == want
            assert "".join(text[a:b] for a, b in windows(text, "\n", size)) == text


def test_long_texts(docs_of):
    lines, one = "word word\n" * 200_000, "x" * 1_500_000
    rows = {x.doc_id: x for x in transformed(docs_of([(1, lines, "en", "a"), (2, one, "en", "a")]))}
    for k, text in ((1, lines), (2, one)):
        assert (rows[k].n, rows[k].form, rows[k].prefix_chars, rows[k].middle_chars, rows[k].output) == by_hand(k, text)


def test_sentinels_that_could_run_together_are_refused(docs_of):
    for bad in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("<P>", "", "<M>"), ("ab", "bc", "d")):
        with pytest.raises(ValueError):
            fill_in_middle(docs_of([]), sentinels=bad)


def test_ids_of_other_types_and_other_units(spark):
    docs = spark.createDataFrame([("a-1", "one two three"), (None, "four"), ("a-1", "one two three")], "doc_id string, text string")
    rows = transformed(docs, units=r"\s*\S+", cut_after=None)
    for x in rows:
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == by_hand(x.doc_id, x.text, units=r"\s*\S+")
