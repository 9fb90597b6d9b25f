"""Ranked lexical search over an index that is sharded by documents.

``build_index`` reads the documents once for the two statistics that a score
needs (documents with a term, and all terms), then once more to write shards:
a shard is one row that holds the postings of some documents as compressed
sparse rows, a sorted array of terms (64-bit hashes), where the postings of each start, the
document of every posting and its integer impact.  The impact is all of a
score that depends on the document, so a search multiplies and adds integers.
Every term of every whole text is indexed.

``search`` sends the queries to the shards, in blocks of ``QUERY_TERMS``
terms.  In a shard it goes term at a time: the weighted impacts of a term's
postings are added to a dense array with a place for each document.  The k
best of the array are found by ``argpartition``; of the documents that tie
with the k-th, those of least id are taken (documents are sorted by id in a
shard).  The best of the shards meet in a window that keeps k rows for each
query before they are shuffled.

Terms are the maximal runs of ASCII letters and digits and of characters
beyond ASCII; only A-Z are lower-cased.  For N documents with a term, L terms
in all, n terms in the document, df documents with the term and tf occurrences
of it in the document:

* weight ``floor(1000 ln((2N+2) / (2df+1)))``,
* impact ``(10^9 tf) div (1000 tf + 20 m)`` with ``m = 50 + (50 n N) div L``.

A null text has no term, and a document without one is never found.  A query
is all rows of its id together, each term once; a null id is an id like
others, a query without a known term finds nothing.  Repeated rows are
documents of their own.  Equal scores come by ascending id, null first; ids
may have any type that sorts.  Empty tables give an empty result.  Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import load, saved

#: Fixed value: what a term is.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = np.zeros(256, dtype=np.uint8)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    TERM_BYTES[_lo:_hi] = 1
#: A shard is closed when it has so many terms with repeats; it has at most some 12 bytes for each.
SHARD_TERMS = 1_500_000
#: Terms of the queries that go out together, about; a task holds some 30 bytes for each.
QUERY_TERMS = 2_000_000


@dataclass
class Index:
    """``shards(ids, terms, starts, docs, impacts)`` and the two statistics of the corpus."""

    shards: DataFrame
    documents: int
    terms: int


def _ratio(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """``50 + (50 n documents) div terms``; beyond 64 bits in whole numbers of any size."""
    if 50 * documents * int(n.max(initial=0)) < 2**63:
        return 50 + (50 * n * documents) // terms
    return np.array([50 + 50 * int(x) * documents // terms for x in n], np.int64)


def _shard(parts: list[tuple[pa.Array, W.Words]], documents: int, terms: int) -> dict[str, pa.Array]:
    ids = pa.concat_arrays([i for i, _ in parts])
    order = pc.sort_indices(ids, null_placement="at_start").to_numpy().astype(np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    size = np.concatenate([np.diff(w.offsets) for _, w in parts]).astype(np.int64)
    term, which = np.unique(np.concatenate([w.hashes for _, w in parts]), return_inverse=True)
    pairs, tf = np.unique(which * len(rank) + np.repeat(rank, size), return_counts=True)
    doc = pairs % max(1, len(rank))
    starts = np.searchsorted(pairs, np.arange(len(term) + 1) * len(rank))
    m = _ratio(size, documents, terms)[order]
    impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
    return {
        "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order))),
        "terms": pa.array([term.tobytes()], pa.binary()),
        "starts": pa.array([starts.astype(np.int32).tobytes()], pa.binary()),
        "docs": pa.array([doc.astype(np.int32).tobytes()], pa.binary()),
        "impacts": pa.array([impact.astype(np.int32).tobytes()], pa.binary()),
    }


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Index:
    """The index of every whole text of ``docs``, kept in the shared checkpoint folder."""
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    n = F.regexp_count("text", F.lit(TERM)).cast("long")
    documents, terms = rows.agg(F.count(F.when(n > 0, 1)), F.coalesce(F.sum(n), F.lit(0))).first()
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            for a, e, words in W.tokens(b.column(1), TERM_BYTES):
                parts.append((b.column(0).slice(a, e - a), words))
                size += len(words.hashes)
                if size >= SHARD_TERMS:
                    yield pa.RecordBatch.from_pydict(_shard(parts, documents, terms))
                    parts, size = [], 0
        if size:
            yield pa.RecordBatch.from_pydict(_shard(parts, documents, terms))

    shards = rows.where(F.col("text").isNotNull()).mapInArrow(build, f"ids array<{id_type}>, terms binary, starts binary, docs binary, impacts binary")
    return Index(saved(shards), documents, terms)


def query_terms(queries: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """``item, term``: the distinct terms (hashes) of each query."""
    rows = queries.select(F.col(f"`{key}`").alias("item"), F.col(f"`{text}`").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, e, words in W.tokens(b.column(1), TERM_BYTES):
                which = np.repeat(np.arange(a, e), np.diff(words.offsets))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which)), pa.array(words.hashes.view(np.int64))], ["item", "term"])

    return rows.mapInArrow(cut, f"item {rows.schema['item'].dataType.simpleString()}, term long").distinct()


def _array(column: pa.Array, row: int, kind: type) -> np.ndarray:
    return np.frombuffer(column[row].as_buffer(), kind)


def _found(held: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted terms a shard has, and where."""
    at = np.minimum(np.searchsorted(held, wanted), max(0, len(held) - 1))
    return (held[at] == wanted if len(held) else np.zeros(len(wanted), bool)), at


def document_frequencies(index: Index, terms: np.ndarray) -> np.ndarray:
    """How many documents hold each of ``terms`` (sorted hashes), summed over the shards."""
    sent = index.shards.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for b in batches:
            for row in range(b.num_rows):
                hit, at = _found(_array(b.column(0), row, np.uint64), sent.value)
                total[hit] += np.diff(_array(b.column(1), row, np.int32))[at[hit]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["place", "df"])

    out = np.zeros(len(terms), np.int64)
    summed = index.shards.select("terms", "starts").mapInArrow(count, "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).toArrow()
    out[summed["place"].to_numpy()] = summed["df"].to_numpy()
    return out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0; of those equal to the k-th the first ones."""
    hit = np.flatnonzero(scores)
    if len(hit) <= k:
        return hit
    found = scores[hit]
    kth = found[np.argpartition(found, len(found) - k)[len(found) - k]]
    above = hit[found > kth]
    return np.concatenate((above, hit[found == kth][: k - len(above)]))


def _search_block(index: Index, block: pa.Table, k: int) -> DataFrame:
    """``item, doc_id, score``: for each query the k best of every shard.  ``block`` has (item, term) rows, sorted by item."""
    items = block.column("item").combine_chunks()
    terms, place = np.unique(block.column("term").to_numpy().astype(np.int64).view(np.uint64), return_inverse=True)
    df = document_frequencies(index, terms)
    weight = np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    code = items.dictionary_encode(null_encoding="encode")
    first = np.flatnonzero(np.diff(code.indices.to_numpy(), prepend=-1))
    sent = index.shards.sparkSession.sparkContext.broadcast((terms, weight, place, np.append(first, len(place)), items.take(pa.array(first))))
    id_type = index.shards.schema["ids"].dataType.elementType

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, place, at_item, names = sent.value
        for b in batches:
            for row in range(b.num_rows):
                ids = b.column(0)[row].values
                starts, docs, impacts = (_array(b.column(c), row, np.int32) for c in (2, 3, 4))
                hit, at = _found(_array(b.column(1), row, np.uint64), terms)
                held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                scores = np.zeros(len(ids), np.int64)
                who, where, value = [], [], []
                for i in range(len(names)):
                    own = place[at_item[i] : at_item[i + 1]]
                    scores[:] = 0
                    for t in own[hit[own]].tolist():
                        if t not in held:
                            a, e = starts[at[t]], starts[at[t] + 1]
                            held[t] = (docs[a:e], impacts[a:e] * weight[t])
                        doc, gain = held[t]
                        scores[doc] += gain
                    top = best(scores, k)
                    who.append(np.full(len(top), i))
                    where.append(top)
                    value.append(scores[top])
                if who:
                    who, where = np.concatenate(who), np.concatenate(where)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(who)), ids.take(pa.array(where)), pa.array(np.concatenate(value))], ["item", "doc_id", "score"])

    return index.shards.select("ids", "terms", "starts", "docs", "impacts").mapInArrow(score, f"item {_spark_type(block)}, doc_id {id_type.simpleString()}, score long")


def _spark_type(block: pa.Table) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(block.schema.field("item").type).simpleString()


def search(index: Index, queries: DataFrame, k: int = 50, text: str = "text", key: str = "item_id") -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each query."""
    terms = saved(query_terms(queries, text, key))
    blocks = max(1, math.ceil(terms.count() / QUERY_TERMS))
    found = None
    for block in range(blocks):
        part = terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        rows = _search_block(index, part.orderBy("item").toArrow(), k)
        rows = rows if blocks == 1 else saved(rows)
        found = rows if found is None else found.unionByName(rows)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each ``benchmark`` item, of all whole texts."""
    return search(build_index(load(spark, sf_dir, "documents")), load(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM t),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM t) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
g AS (SELECT q.item_id, p.r, p.doc_id, CAST(sum(CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM q JOIN p ON q.term = p.term JOIN d ON d.term = q.term CROSS JOIN s GROUP BY 1, 2, 3),
k AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM g WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50"""
