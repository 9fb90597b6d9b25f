"""Benchmark decontamination by greedy string tiling.

A benchmark item and a document are compared as word sequences.  Runs of
``LEAST_MATCH`` equal words, found by their running Karp-Rabin hashes, are the
seeds; a document meets only items that share a seed with it.  Seeds on one
diagonal join to maximal matches.  Then the longest match of words that are
not yet marked is marked, again and again, until none has ``LEAST_MATCH``
words.  A marked match is a tile.  Tiles may stand in any order in the
document, so a reordered passage is found as well.  The item has leaked if its
tiles cover ``COVERAGE`` of its words or more.  An item of fewer words has one
seed, all of it.

The benchmark is the query set.  It goes to the tasks in blocks of about
``BLOCK_WORDS`` words; every block is compared with all documents where they
are, so no document text is shuffled.  Of several blocks one is sent at a
time, its leaks are kept, and it is taken back before the next goes out.

What a task holds is a batch of texts, one block, and the maximal matches of
one item in one document.  Where a few words repeat so often that the pairs of
their places would be too many, matches are followed place by place of the
item instead, with the same result.

Words are runs of letters and digits, lower-cased.  A null text is empty.
Repeated documents each get their leaks; a repeated item is reported each
time.  Extra columns pass through.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import fresh_name, load, saved

LEAST_MATCH, COVERAGE = 5, 0.6
#: Words of the benchmark that are searched for together, about (some 40 bytes each in a task).
BLOCK_WORDS = 2_000_000
#: Pairs of equal places that are laid out at once; with more, matches are followed place by place.
PAIRS_AT_ONCE = 200_000

_LETTERS = (W.LETTERS_AND_MARKS == 1).astype(np.uint8)


def _lower(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(col.cast(pa.large_string()))


def runs_of_pairs(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Rows (item place, document place, seeds) of the maximal runs on one diagonal among the pairs of places."""
    by = np.lexsort((p, t - p))
    p, t = p[by], t[by]
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(p) != 1) | (np.diff(t) != 1)
    start = np.flatnonzero(new)
    return np.column_stack((p[start], t[start], np.diff(np.append(start, len(p)))))


def runs_by_place(places: list[tuple[int, np.ndarray]], size: int) -> np.ndarray:
    """The same for (item place, its document places), ascending, in memory of the document and the runs."""
    length, out = np.zeros(size + 1, np.int64), []
    last_p, last_t = -2, np.zeros(0, np.int64)
    for p, t in [*places, (-9, np.zeros(0, np.int64))]:
        here = np.zeros(size + 1, np.int64)
        if p == last_p + 1:
            here[t] = length[t - 1] * (t > 0) + 1
            ended = last_t[here[np.minimum(last_t + 1, size)] == 0] if len(t) else last_t
        else:
            here[t] = 1
            ended = last_t
        if len(ended):
            out.append(np.column_stack((last_p - length[ended] + 1, ended - length[ended] + 1, length[ended])))
        length, last_p, last_t = here, p, t
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def tile_runs(runs: np.ndarray, least: int = LEAST_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (item start, document start, words) from maximal runs of seeds.

    A run of k seeds is a match of k + least - 1 words.  Of equally long
    matches the first in the item, then in the document, is marked.  A match
    that meets a marked word is cut to what is left of it and waits again.
    """
    heap = [(-(k + least - 1), p, t) for p, t, k in runs.tolist()]
    heapq.heapify(heap)
    if not heap:
        return []
    used_p = np.zeros(max(p - n for n, p, _ in heap) + 1, bool)
    used_t = np.zeros(max(t - n for n, _, t in heap) + 1, bool)
    tiles = []
    while heap:
        n, p, t = heapq.heappop(heap)
        n = -n
        free = ~(used_p[p : p + n] | used_t[t : t + n])
        if free.all():
            tiles.append((p, t, n))
            used_p[p : p + n] = used_t[t : t + n] = True
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(heap, (a - b, p + a, t + a))
    return tiles


@dataclass
class Items:
    """A block of the benchmark: seeds sorted by hash, where each stands, and a filter on the hashes' low bits.

    ``short`` has the hashes and numbers of the items of k < ``LEAST_MATCH`` words, by k.
    """

    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    ids: list
    sizes: np.ndarray
    filter: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: list, texts: pa.Array) -> Items:
        seeds, item, place, sizes, short = [], [], [], [], {}
        for a, _, words in W.tokens(_lower(texts), _LETTERS):
            count = np.diff(words.offsets)
            sizes += count.tolist()
            g = W.grams(words, LEAST_MATCH)
            n = np.diff(g.offsets)
            seeds.append(g.hashes)
            item.append(np.repeat(np.arange(a, a + len(words)), n))
            place.append(np.arange(len(g.hashes)) - np.repeat(g.offsets[:-1], n))
            for k in range(1, LEAST_MATCH):
                at = np.flatnonzero(count == k)
                if len(at):
                    g = W.grams(words, k)
                    short.setdefault(k, []).append((g.hashes[g.offsets[at]], a + at))
        h = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        by = np.argsort(h, kind="stable")
        bits = np.zeros(1 << 20, bool)
        bits[h & W.U64((1 << 20) - 1)] = True
        pick = lambda x: np.concatenate(x)[by].astype(np.int64) if x else np.zeros(0, np.int64)
        joined = {k: tuple(np.concatenate(x) for x in zip(*v, strict=True)) for k, v in short.items()}
        return cls(h[by], pick(item), pick(place), ids, np.array(sizes, np.int64), bits, joined)

    def found(self, words: W.Words) -> list[list[dict]]:
        """The leaked items of each document."""
        g = W.grams(words, LEAST_MATCH)
        out = [self.leaks(g.hashes[g.offsets[i] : g.offsets[i + 1]]) for i in range(len(words))]
        for k, (hashes, item) in self.short.items():
            g = W.grams(words, k)
            for row in range(len(words)):
                hit = np.isin(hashes, g.hashes[g.offsets[row] : g.offsets[row + 1]])
                out[row] += [{"item": self.ids[i], "coverage": 1.0, "tiles": 1, "longest": k} for i in item[hit].tolist()]
        return out

    def leaks(self, hashes: np.ndarray) -> list[dict]:
        """The leaked items of a document whose running hashes are given."""
        at = np.flatnonzero(self.filter[hashes & W.U64((1 << 20) - 1)])
        if not len(at) or not len(self.seeds):
            return []
        at = at[np.argsort(hashes[at], kind="stable")]
        seed, first, count = np.unique(hashes[at], return_index=True, return_counts=True)
        low, high = np.searchsorted(self.seeds, seed, "left"), np.searchsorted(self.seeds, seed, "right")
        n = high - low
        if not n.sum():
            return []
        s = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        which, item, place = np.repeat(np.arange(len(seed)), n), self.item[s], self.place[s]
        by = np.lexsort((place, item))
        which, item, place = which[by], item[by], place[by]
        out = []
        cut = np.flatnonzero(np.diff(item, prepend=-1))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(item)], strict=True):
            i, p, u = int(item[a]), place[a:b], which[a:b]
            # Tiles hold no more item words than its seeds touch.
            if int(np.minimum(np.diff(p, append=p[-1] + LEAST_MATCH), LEAST_MATCH).sum()) < COVERAGE * self.sizes[i]:
                continue
            if count[u].sum() <= PAIRS_AT_ONCE:
                each = count[u]
                t = at[np.repeat(first[u] - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(each.sum())]
                runs = runs_of_pairs(np.repeat(p, each), t)
            else:
                runs = runs_by_place([(int(x), at[first[k] : first[k] + count[k]]) for x, k in zip(p, u, strict=True)], len(hashes))
            tiles = tile_runs(runs)
            covered = sum(x[2] for x in tiles)
            if covered >= COVERAGE * self.sizes[i]:
                out.append({"item": self.ids[i], "coverage": covered / int(self.sizes[i]), "tiles": len(tiles), "longest": max(x[2] for x in tiles)})
        return out


def _leak_type(id_type: str) -> str:
    return f"array<struct<item:{id_type},coverage:double,tiles:int,longest:int>>"


def _searcher(sent: Broadcast, id_type: str, arrow_id: pa.DataType):
    """The column function that compares a text with one block of the benchmark."""

    @F.arrow_udf(_leak_type(id_type))
    def search(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = sent.value
        kind = pa.list_(pa.struct([("item", arrow_id), ("coverage", pa.float64()), ("tiles", pa.int32()), ("longest", pa.int32())]))
        for col in texts:
            yield pa.array([x for _, _, words in W.tokens(_lower(col), _LETTERS) for x in items.found(words)], kind)

    return search


def _blocks(benchmark: DataFrame) -> Iterator[tuple[pa.Table, int]]:
    """The items in blocks of about ``BLOCK_WORDS`` words, by a hash of id and text, equal items under numbers of their own; and how many blocks there are."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, round(size / (6 * BLOCK_WORDS)))
    counted = items.groupBy("item_id", "text").agg(F.count("*").alias("n"))
    numbered = counted.select("item_id", "text", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("nr"))
    for k in range(blocks):
        yield numbered.where(F.pmod(F.xxhash64("item_id", "text", "nr"), F.lit(blocks)) == k).orderBy("item_id", "text", "nr").select("item_id", "text").toArrow(), blocks


def find_leaks(docs: DataFrame, benchmark: DataFrame, out: str = "leaks") -> DataFrame:
    """``docs`` with ``out``: the leaked items of each text, as item, coverage, tiles and longest tile (words)."""
    id_type = benchmark.schema["item_id"].dataType.simpleString()
    leaked = None
    for rows, blocks in _blocks(benchmark):
        ids = rows.column("item_id").combine_chunks()
        sent = docs.sparkSession.sparkContext.broadcast(Items.of(ids.to_pylist(), rows.column("text").combine_chunks()))
        search = _searcher(sent, id_type, ids.type)
        if blocks == 1:
            return docs.withColumn(out, search(F.col("text")))
        # Equal texts have equal leaks, so a text's hash and length name its row.
        part = saved(_known_texts(docs).withColumn("_leaks", search(F.col("text"))).where(F.size("_leaks") > 0).groupBy("_h", "_g").agg(F.first("_leaks").alias("_leaks")))
        sent.destroy()
        leaked = part if leaked is None else leaked.unionByName(part)
    joined = leaked.groupBy("_h", "_g").agg(F.flatten(F.collect_list("_leaks")).alias("_leaks"))
    h, g, row = (fresh_name(docs, x) for x in ("_h", "_g", "_row"))
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), F.xxhash64("text").alias(h), F.xxhash64(F.lit(1), "text").alias(g))
    joined = joined.select(F.col("_h").alias("_h2"), F.col("_g").alias("_g2"), "_leaks")
    with_leaks = marked.join(joined, (F.col(h) == F.col("_h2")) & (F.col(g) == F.col("_g2")), "left")
    none = F.expr(f"cast(array() as {_leak_type(id_type)})")
    return with_leaks.select(f"{row}.*", F.coalesce("_leaks", none).alias(out))


def _known_texts(docs: DataFrame) -> DataFrame:
    """``text`` and two 64-bit hashes of it."""
    return docs.select("text", F.xxhash64("text").alias("_h"), F.xxhash64(F.lit(1), "text").alias("_g"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that leaked into a document: one row for each document and item."""
    found = find_leaks(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", F.col("leak.item").alias("item_id"), "leak.coverage", "leak.tiles", "leak.longest")
