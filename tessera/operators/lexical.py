"""An inverted index with block maxima, and ranked retrieval that skips blocks.

The documents are dealt by a hash of their id into blocks of about
``BLOCK_DOCS``.  A posting row holds what one block has of one term: the
documents, the weight of the term in each, and the greatest of these weights.
So neither a frequent term nor a long table makes a long row.

A query reads the maxima first: their sum over its terms bounds the score of
every document in a block.  The blocks of the highest bounds are scored, and
after that only those whose bound reaches the k-th score that was found.  The
result is that of scoring every document.

A term's weight in a document is the sum of 1 / j^2 over its occurrences j, up
to ``MOST_OCCURRENCES``; a document's rank for a query is the sum of the weights
of the query's terms, over the number of terms, times ``UNIT``, which is the
usual rank of text search with one class of weights.  Terms are runs of ASCII
letters and digits in lower case, without stemming.  A query asks for any of
its terms ("or") or for all ("and").
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import saved

BLOCK_DOCS, FIRST_BLOCKS = 2048, 4
#: Weight of an occurrence over the sum of all 1 / j^2, and the occurrences that count.
UNIT, MOST_OCCURRENCES = 0.1 / 1.64493406685, 255
TERM = "[a-z0-9]+"
#: Terms that go to every task at most; more are joined, for which all words are shuffled.
SENT_TERMS = 200_000


def text_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def occurrence_weight(count: Column) -> Column:
    """1 + 1/4 + 1/9 + ... for so many occurrences."""
    return F.aggregate(F.sequence(F.lit(1), F.least(count.cast("int"), F.lit(MOST_OCCURRENCES))), F.lit(0.0), lambda s, j: s + 1 / (j * j).cast("double"))


def build_postings(docs: DataFrame, only: DataFrame | None = None, block_docs: int | None = None) -> DataFrame:
    """``term, block, most, postings`` of ``docs(id, text)``; rows of one id are one document.

    ``only(term)`` leaves out other terms, for a run whose queries are known.
    """
    blocks = max(1, -(-docs.count() // (block_docs or BLOCK_DOCS)))
    words = docs.select("id", F.explode(text_terms(F.col("text"))).alias("term"))
    if only is not None:
        asked = only.select("term").distinct()
        words = words.join(F.broadcast(asked) if asked.limit(SENT_TERMS + 1).count() <= SENT_TERMS else asked, "term", "left_semi")
    counted = words.groupBy("id", "term").agg(F.count("*").alias("n")).select("id", "term", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), occurrence_weight(F.col("n")).alias("weight"))
    return saved(counted.groupBy("term", "block").agg(F.max("weight").alias("most"), F.collect_list(F.struct("id", "weight")).alias("postings")))


def _scored(postings: DataFrame, asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """``query, id, raw, found`` of all documents in ``blocks(query, block)``."""
    rows = blocks.join(asked, "query").join(postings.select("term", "block", "postings"), ["term", "block"])
    return rows.select("query", F.explode("postings").alias("p")).groupBy("query", "p.id").agg(F.round(F.sum("p.weight"), 9).alias("raw"), F.count("*").alias("found"))


def _best_of_blocks(postings: DataFrame, asked: DataFrame, blocks: DataFrame, k: int, every: bool) -> DataFrame:
    """``query, id, raw`` of the k best documents of each of ``blocks(query, block)``; a block's postings meet its queries in one group, so no posting becomes a row."""
    visits = blocks.join(asked, "query").select(F.col("block").alias("at"), "query", F.col("term").alias("t"))
    query, document = asked.schema["query"].dataType, postings.schema["postings"].dataType.elementType["id"].dataType
    schema = f"query {query.simpleString()}, id {document.simpleString()}, raw double"

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks().sort_by([("query", "ascending"), ("t", "ascending")])
        lists = left["postings"].combine_chunks() if len(left) else pa.array([], left.schema.field("postings").type)
        ids, weights = lists.flatten().field("id"), lists.flatten().field("weight").to_numpy(zero_copy_only=False)
        known = pc.unique(ids).take(pc.sort_indices(pc.unique(ids)))
        place = pc.index_in(ids, known).to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)) if len(lists) else np.zeros(0, np.int64)
        of = {t: slice(a, z) for t, a, z in zip(left["term"].to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True)} if len(lists) else {}
        wanted: dict = {}
        for q, t in zip(right["query"].to_pylist(), right["t"].to_pylist(), strict=True):
            wanted.setdefault(q, []).append(t)
        who, what, raws = [], [], []
        for q, terms in wanted.items():
            raw, found = np.zeros(len(known)), np.zeros(len(known), np.int64)
            for at in (of[t] for t in terms if t in of):
                raw[place[at]] += weights[at]  # a list names a document once
                found[place[at]] += 1
            raw = np.round(raw, 9)
            some = np.flatnonzero(found == len(terms) if every else found > 0)
            if len(some) > k:
                some = some[raw[some] >= np.partition(raw[some], len(some) - k)[len(some) - k]]
            some = some[np.argsort(-raw[some], kind="stable")][:k]  # ids ascend
            who += [q] * len(some)
            what.append(some)
            raws.append(raw[some])
        at = np.concatenate(what) if what else np.zeros(0, np.int64)
        return pa.table({"query": pa.array(who, right.schema.field("query").type), "id": known.take(pa.array(at, pa.int64())), "raw": np.concatenate(raws) if raws else np.zeros(0)})

    wanted = postings.join(asked.select("term").distinct(), "term", "left_semi").select("block", "term", "postings")
    return wanted.groupBy("block").cogroup(visits.groupBy("at")).applyInArrow(score, schema)


def search_postings(postings: DataFrame, queries: DataFrame, k: int, every: bool = False, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``query, id, score, rank``: the k best documents of each of ``queries(query, term)``, ties by id.

    ``every``: a document must hold all terms of the query.  ``keep`` leaves
    out rows (query, id, ...) before the k best are taken.
    """
    asked = saved(queries.select("query", "term").distinct())
    sizes = asked.groupBy("query").agg(F.count("*").alias("terms"))
    bounds = asked.join(postings.select("term", "block", "most"), "term").groupBy("query", "block").agg(F.sum("most").alias("bound"), F.count("*").alias("present"))
    if every:
        bounds = bounds.join(sizes, "query").where(F.col("present") == F.col("terms"))
    best_first = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    bounds = saved(bounds.select("query", "block", "bound", F.row_number().over(best_first).alias("turn")))
    order = Window.partitionBy("query").orderBy(F.desc("raw"), "id")

    def top(rows: DataFrame) -> DataFrame:
        return saved(rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))

    def scored(blocks: DataFrame) -> DataFrame:
        if keep is None:
            return _best_of_blocks(postings, asked, blocks.select("query", "block"), k, every)
        rows = _scored(postings, asked, blocks.select("query", "block"))
        if every:
            rows = rows.join(sizes, "query").where(F.col("found") == F.col("terms"))
        return keep(rows.select("query", "id", "raw")).select("query", "id", "raw")

    first = top(scored(bounds.where(F.col("turn") <= FIRST_BLOCKS)))
    bar = first.where(F.col("rank") == k).select("query", F.col("raw").alias("bar"))
    rest = bounds.where(F.col("turn") > FIRST_BLOCKS).join(bar, "query", "left").where(F.col("bar").isNull() | (F.col("bound") >= F.col("bar") - 1e-6))
    found = first.select("query", "id", "raw")
    if rest.limit(1).count():
        found = top(found.unionByName(scored(rest)))
    else:
        found = first
    return found.join(sizes, "query").select("query", "id", (F.col("raw") * UNIT / F.col("terms")).alias("score"), "rank")
