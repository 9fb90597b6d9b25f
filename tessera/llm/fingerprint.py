"""Document fingerprints by I-Match with several randomised lexicon subsets.

The lexicon holds the terms within a band of document frequency (equally, of
inverse document frequency): not so rare that one typing slip makes the term,
not so common that it tells nothing.  Document frequencies are counted
exactly over all documents, by 64-bit hashes of terms in a shuffle, so a term
of one document is never in the lexicon, whatever the size of the corpus.
Tasks hold the lexicon as a sorted array, 8 bytes a term within the band.

A document keeps its distinct terms in the lexicon, sorted, and hashes them:
the first part of the fingerprint, equal for equal term sets.  The other
parts do the same, sort and hash, for random subsets of the lexicon.  The
first ``OVERLAPPING`` of them keep each term with chance 3/4 for itself, so
they overlap; documents that differ in a few terms agree in those subsets
which miss these terms.  The others come in levels and tell how much is left
of a text: level k keeps each term with chance 4^-k and deals what it keeps
to ``SLOTS`` disjoint subsets, so that documents of any length have a level
whose subsets hold about one of their terms each.  The likeness of two
fingerprints is the share of subsets that agree, among the overlapping ones
or the non-empty ones of a level, whichever tells most.

A text without a term in the lexicon is fingerprinted by all of its words.
Equal texts have equal fingerprints; null counts as empty.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import load, saved

OVERLAPPING, SLOTS, LEVELS = 8, 32, 5
SLOT_BITS = SLOTS.bit_length() - 1
#: A term of the lexicon is in two documents at least and in at most this share of all.
LEAST_DF, MOST_SHARE = 2, 0.1
#: Rows that a task of the final pass gets, about, the most such tasks, ranges of rows for each and sampled keys for a range's edge.
TASK_ROWS, MOST_TASKS, TASK_PARTS, EDGE_KEYS = 2000, 20_000, 4, 10


#: Distinct terms that a task of the count holds before it sends them on.
COUNT_TERMS = 1_000_000


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    terms, at = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
    return terms, np.bincount(at, np.concatenate([n for _, n in parts]), len(terms)).astype(np.int64)


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``term`` (its hash) and ``n``: in how many rows it is, exactly."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(terms: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], ["term", "n"])

        held, size = [], 0
        for b in batches:
            for _, _, words in W.tokens(b.column(0), W.LETTERS_AND_MARKS):
                row = np.repeat(np.arange(len(words)), np.diff(words.offsets))
                order = np.lexsort((row, words.hashes))
                h, r = words.hashes[order], row[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                terms, n = np.unique(h[first], return_counts=True)
                held.append((terms, n))
                size += len(terms)
                if size > 2 * COUNT_TERMS:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > COUNT_TERMS:
                        yield batch(*held[0])
                        held, size = [], 0
        if held:
            yield batch(*_merged(held))

    return docs.select(text).mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text: str = "text", least: int = LEAST_DF, most_share: float = MOST_SHARE) -> np.ndarray:
    """Hashes of the terms within the band, sorted."""
    found = document_frequencies(docs, text).where((F.col("n") >= least) & (F.col("n") <= max(least, most_share * docs.count())))
    terms = found.select("term").toArrow()["term"].to_numpy().astype(np.int64).view(np.uint64)
    terms.sort()
    return terms


def _inside(hashes: np.ndarray, lex: np.ndarray) -> np.ndarray:
    if not len(lex):
        return np.zeros(len(hashes), bool)
    # Sorted, distinct keys walk through the lexicon in order.
    keys, at = np.unique(hashes, return_inverse=True)
    return (lex[np.minimum(np.searchsorted(lex, keys), len(lex) - 1)] == keys)[at]


def fingerprints(col: pa.Array, lex: np.ndarray) -> Iterator[np.ndarray]:
    """For each text its parts (0: no term): the whole lexicon's hash, ``OVERLAPPING`` of 64 bits, then ``LEVELS * SLOTS`` of 32 bits."""
    for _, _, words in W.tokens(col, W.LETTERS_AND_MARKS):
        kept = _inside(words.hashes, lex)
        for i in range(len(words)):
            h, keep = words.hashes[words.offsets[i] : words.offsets[i + 1]], kept[words.offsets[i] : words.offsets[i + 1]]
            terms = np.unique(h[keep])
            yield _parts(terms if len(terms) else np.unique(h))


def _hash(terms: np.ndarray) -> int:
    return (int.from_bytes(hashlib.blake2b(terms.tobytes(), digest_size=8).digest(), "big") or 1) if len(terms) else 0


def _parts(terms: np.ndarray) -> np.ndarray:
    """``terms`` are distinct and sorted; every subset is hashed in their order."""
    out = np.zeros(1 + OVERLAPPING + LEVELS * SLOTS, np.uint64)
    if not len(terms):
        return out
    draw = W.mix(terms + W.U64(1))
    out[0] = _hash(terms)
    for k in range(OVERLAPPING):  # two bits of the draw leave out a quarter
        out[1 + k] = _hash(terms[(draw >> W.U64(20 + 2 * k)) & W.U64(3) != 0])
    for level in range(LEVELS):
        chosen = draw[(draw & W.U64((1 << 2 * level) - 1)) == 0]
        if not len(chosen):
            break
        slot = (chosen >> W.U64(64 - SLOT_BITS)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        at = np.searchsorted(slot[order], np.arange(SLOTS + 1))
        place = np.arange(len(order)) - at[slot[order]]  # a term's place in its subset
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(W.mix(chosen[order] + place.astype(np.uint64)))))
        value = W.mix(sums[at[1:]] - sums[at[:-1]]) >> W.U64(32)
        first = 1 + OVERLAPPING + level * SLOTS
        out[first : first + SLOTS] = np.where(at[1:] > at[:-1], np.maximum(value, W.U64(1)), W.U64(0))
    return out


def as_text(parts: np.ndarray) -> str:
    return parts[: 1 + OVERLAPPING].astype(">u8").tobytes().hex() + parts[1 + OVERLAPPING :].astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: 1 for equal fingerprints, else the best share of agreeing subsets: overlapping ones, or a level that is full enough."""
    if a[0] == b[0]:
        return 1.0
    x, y = a[1 : 1 + OVERLAPPING], b[1 : 1 + OVERLAPPING]
    best = float(((x == y) & (x > 0)).sum() / OVERLAPPING)
    x, y = a[1 + OVERLAPPING :].reshape(LEVELS, SLOTS), b[1 + OVERLAPPING :].reshape(LEVELS, SLOTS)
    full = ((x > 0) | (y > 0)).sum(axis=1)
    same = ((x == y) & (x > 0)).sum(axis=1)
    usable = full >= SLOTS // 4
    if not usable.any():
        return max(best, float(same[0] / full[0]) if full[0] else 0.0)
    return max(best, float((same[usable] / full[usable]).max()))


def _same(a: DataFrame, b: DataFrame) -> list:
    return [a["doc_id"].eqNullSafe(b["doc_id"]), a["h"] == b["h"]]


def _chain(keyed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Each different row ``doc_id, h, text`` once, and the rows that stand more than once with ``again``, how often beyond the first."""
    many = saved(keyed.groupBy("doc_id", "h").agg(F.count("*").alias("m")).where("m > 1"))
    if not many.limit(1).count():
        return keyed, None
    once = keyed.join(many, _same(keyed, many), "left_semi").dropDuplicates(["doc_id", "h"])
    again = once.join(many, _same(once, many)).select(once["doc_id"], "text", (F.col("m") - 1).alias("again"))
    return keyed.join(many, _same(keyed, many), "left_anti").unionByName(once), again


def with_next(chain: DataFrame) -> tuple[DataFrame, int]:
    """``doc_id, h, text, part, stand_in``: rows by parts of (``doc_id``, ``h``) order, each part followed by the next one's first row.

    Parts are ranges of keys; a key is in one row only, so no id can fill a
    part.  Their edges come from a sample of the keys.  The first row of a
    part is also sent to the part before it (that of the first part to the
    last), as ``stand_in``.  So one shuffle of the texts puts every document
    beside its successor.  The number of tasks comes with it.
    """
    rows = chain.count()
    tasks = max(1, min(MOST_TASKS, rows // TASK_ROWS))
    parts, edges = tasks * TASK_PARTS, []
    if rows:
        place = F.pmod(F.xxhash64(F.lit(3), "doc_id", "h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        drawn = chain.select("doc_id", "h").where(place < min(1.0, EDGE_KEYS * parts / rows)).collect()
        keys = sorted(_key(*r) for r in drawn)  # about EDGE_KEYS * parts, which MOST_TASKS bounds
        edges = sorted({keys[len(keys) * k // parts] for k in range(1, parts)}) if keys else []
    sent = chain.sparkSession.sparkContext.broadcast(edges)

    @F.arrow_udf("long")
    def place_of(ids: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array([bisect.bisect_right(sent.value, _key(x, y)) for x, y in zip(ids.to_pylist(), h.to_pylist(), strict=True)], pa.int64())

    numbered = chain.select("doc_id", "h", "text", place_of("doc_id", "h").alias("part"))
    # One row for each part.
    firsts = saved(numbered.groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("first")))
    order = [r["part"] for r in firsts.select("part").orderBy("part").collect()]
    before = chain.sparkSession.createDataFrame([(p, order[k - 1]) for k, p in enumerate(order)], "part long, before long")
    heads = F.broadcast(firsts.join(before, "part").select(F.col("part").alias("p"), "first", "before"))
    copies = numbered.join(heads, (F.col("p") == F.col("part")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.h") == F.col("h")))
    return numbered.withColumn("stand_in", F.lit(False)).unionByName(copies.select("doc_id", "h", "text", F.col("before").alias("part"), F.lit(True).alias("stand_in"))), tasks


def _key(doc_id, h: int) -> tuple:
    """Sorts as Spark does: null first."""
    return (doc_id is not None, doc_id if doc_id is not None else 0, h)


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _digests(rows: list[tuple], lex: np.ndarray, id_type: pa.DataType, extra: list | None = None) -> pa.RecordBatch:
    """Result rows for ``((doc_id, text), (next id, next text))``, and ``extra`` as a last column."""
    edited = []
    for (_, text), (_, after) in rows:
        half = len(text) // 2
        edited.append(text[: len(text) - half] + after[:half])
    own = list(fingerprints(pa.array([p[0][1] for p in rows], pa.large_string()), lex))
    new = list(fingerprints(pa.array(edited, pa.large_string()), lex))
    # The successor's fingerprint is the next row's own, but for the last of a run.
    after = [own[k + 1] if k + 1 < len(rows) and rows[k + 1][0] is rows[k][1] else next(fingerprints(pa.array([rows[k][1][1]], pa.large_string()), lex)) for k in range(len(rows))]
    out = {
        "doc_id": pa.array([p[0][0] for p in rows], id_type),
        "n_chars": pa.array([len(p[0][1]) for p in rows], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited], pa.string()),
        "fingerprint": pa.array([as_text(x) for x in own], pa.string()),
        "edited_fingerprint": pa.array([as_text(x) for x in new], pa.string()),
        "near_edited": pa.array([likeness(x, y) for x, y in zip(own, new, strict=True)], pa.float64()),
        "near_next": pa.array([likeness(x, y) for x, y in zip(own, after, strict=True)], pa.float64()),
    }
    if extra is not None:
        out["again"] = pa.array(extra, pa.int64())
    return pa.RecordBatch.from_pydict(out)


def fingerprint_with_edit(docs: DataFrame) -> DataFrame:
    """The digest of every text, of its edited text, and their likeness; see ``op2_fingerprints``.

    Ids of any type sort ascending, null first; rows with equal ids by a hash
    of their text.  Of equal rows, all but the last are followed by
    themselves; they are computed once and repeated.  A null text is empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(docs))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("h"), "text")
    chain, again = _chain(keyed)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, which waits for its successor
        for b in batches:
            pairs, size = [], 0
            parts, stands, ids, texts = (b.column(k).to_pylist() for k in range(4))
            for part, stand_in, doc_id, text in zip(parts, stands, ids, texts, strict=True):
                row = (doc_id, text)
                if held and held[0] == part:
                    pairs.append((held[1], row))
                    size += len(text)
                held = None if stand_in else (part, row)
                if size > W.CHUNK_BYTES:
                    yield _digests(pairs, sent.value, b.schema.field("doc_id").type)
                    pairs, size = [], 0
            if pairs:
                yield _digests(pairs, sent.value, b.schema.field("doc_id").type)

    rows, tasks = with_next(chain)
    ordered = rows.repartition(tasks, "part").sortWithinPartitions("part", "stand_in", "doc_id", "h").select("part", "stand_in", "doc_id", "text")
    out = ordered.mapInArrow(digest, f"doc_id {id_type}, {RESULT}")
    if again is None:
        return out

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, more = (b.column(k).to_pylist() for k in range(3))
            if b.num_rows:
                yield _digests([((i, t), (i, t)) for i, t in zip(ids, texts, strict=True)], sent.value, b.schema.field("doc_id").type, more)

    repeated = again.mapInArrow(repeat, f"doc_id {id_type}, {RESULT}, again long").withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "again"))).drop("again", "_k")
    return out.unionByName(repeated)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every whole text of ``documents`` and of its edited text.

    The edited text has the last floor(n_chars / 2) code points replaced by
    as many (or all) first ones of the next document, ascending ``doc_id``.
    """
    return fingerprint_with_edit(load(spark, sf_dir, "documents"))
