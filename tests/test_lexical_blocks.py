"""Documents are scored in the groups of their blocks, not as rows of postings."""

from tessera.operators import lexical as L


def test_no_posting_becomes_a_row(spark, monkeypatch):
    def rows(*_):
        raise AssertionError("postings were exploded")

    monkeypatch.setattr(L, "_scored", rows)
    docs = spark.createDataFrame([(1, "a1 b1 b1"), (2, "b1"), (3, "a1"), (4, "zz")], "id long, text string")
    asked = spark.createDataFrame([(7, "a1"), (7, "b1"), (8, "none")], "query long, term string")
    postings = L.build_postings(docs, asked, block_docs=1)
    assert [(r["query"], r["id"], r["rank"]) for r in L.search_postings(postings, asked, 2).orderBy("rank").collect()] == [(7, 1, 1), (7, 2, 2)]
    assert [r["id"] for r in L.search_postings(postings, asked, 2, every=True).collect()] == [1]
