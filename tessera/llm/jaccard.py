"""N-gram Jaccard join with set-relation skipping: the components of documents that share most of their shingles.

Two documents link when their sets of distinct word shingles have a Jaccard
likeness of ``percent`` / 100 or more.  The join is exact.  What it skips:

1. *Equal sets.*  Copies of a set join once, under its 128-bit digest.
2. *Index lists, block by block.*  The exact part is a prefix index: in an
   order of all shingles from rare to frequent, two linked sets share a
   shingle among their first n - ceil(t n) + 1.  A list's entries stand by
   band of sizes, component and position and are cut into blocks of
   ``LIST_BLOCK``; a block knows its least and greatest component, size,
   position and rest behind the position.  Two blocks meet only if these allow a link between
   sets of different components; all other pairs of blocks are skipped
   unread.  Inside a pair of blocks the same bounds hold for each pair of
   sets, then a bit-parity bound on the symmetric difference.
3. *Components as answers.*  The lists are gone through twice: first for a
   least spanning forest of the components, whose pairs are compared exactly
   and merge most components that link; then for all pairs of components still
   apart.  A task's forest has fewer pairs than the task has components, so a
   group of near copies in many components doesn't give the square of them.
4. *Answers of a highly similar set.*  Sets that share one of their ``probes``
   least shingle hashes are compared with the first set of that hash; a set
   that links has the linked set as its representative and goes into its
   component, so only sets of *different* components need to be compared later
   on.  There the overlap of two representatives is computed first.  A member
   adds to its representative's overlap at most the shingles that it has and
   the representative has not, so the answers of all members follow from the
   representatives' answer and the counts of differing shingles; only pairs
   that this bound leaves open are compared as whole texts.

The order is by counts of all shingles of all documents in a fixed number of
hashed counters, then by hash.  Any order gives exact results; this one keeps
lists short: a passage that many documents share comes last in each of them.

No list, link or component is collected to the driver, and no task gets a
whole list.  Entries travel as packed arrays, one row for each input batch and
range of shingle hashes.  A task drops the shingles of a range that only one
set has; it streams over the rows and holds the distinct shingles of the range
only.  Shingles whose counter is far above the mean skip that step, so a hot
shingle goes through no single task.  The lists that are left are cut into
blocks after a sort by ranges of (shingle, band, component, position, set),
which splits a long list over as many tasks as it fills.  Lists of one least
set are compared in few tasks, which send a pair that many of them hold once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import held, load

SHINGLE_WORDS, PERCENT = 5, 75
#: Least hashes of a set that stage 2 probes; counters of the shingle order; bits of the parity filter and of the text filter.
PROBES, ORDER_BITS, PARITY_BITS, FILTER_BITS = 6, 20, 1024, 23
#: Bits of a set's digest by which index entries name it.
NAME_BITS = 40
#: Index entries that one range of shingle hashes holds, about, and entries in one block of a list.
RANGE_ENTRIES, LIST_BLOCK = 100_000, 512
#: A shingle is hot if its counter exceeds this and HOT_MEANS times the mean counter.
HOT_LEAST, HOT_MEANS = 20_000, 8
#: Index entries that a task gathers before it sends them.
PACK_ENTRIES = 150_000
#: Pairs of one set that are compared in one group; tasks over which the lists of one least set are dealt; pairs that a task remembers.
GROUP_PAIRS, LEAD_TASKS, REMEMBERED_PAIRS = 500, 8, 200_000
#: Pairs that are laid out before they are folded.
FOUND_PAIRS = 50_000


def _sets(col: pa.Array) -> Iterator[np.ndarray]:
    for _, _, words in W.tokens(col):
        yield from W.shingle_sets(words, SHINGLE_WORDS)


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def parity_bits(s: np.ndarray, size: int) -> bytes:
    """For each of ``size`` (a power of two) hash buckets whether it holds an odd number of the set."""
    return np.packbits(np.bincount((s & W.U64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def odd_buckets(a: bytes, b: bytes) -> int:
    """In how many buckets two sets differ in parity, over the smaller one's buckets: at most their symmetric difference."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):  # halves of the larger one lie on each other
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _differing(odd: np.ndarray) -> np.ndarray:
    """About how many shingles two sets differ in whose ``PARITY_BITS`` differ in ``odd`` buckets; many, where the bits are full."""
    return -PARITY_BITS / 2 * np.log(np.maximum(1 - 2 * odd / PARITY_BITS, 1e-3))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """How many first shingles of a set of n must be indexed."""
    return n - -(-percent * n // 100) + 1


def needed_overlap(a, b, percent: int = PERCENT):
    """The least common shingles of linked sets of sizes a and b (numbers or arrays)."""
    return -(-(percent * (a + b)) // (100 + percent))


# -- profiles ------------------------------------------------------------------


PROFILE = "n long, hi long, lo long, least array<long>, parity binary, wide binary"


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, h, text``: ``h`` tells apart different texts of one id."""
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text")


def profiles(docs: DataFrame) -> DataFrame:
    """``doc_id, h``, set size, digest, least hashes and parity bits of every document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, hi, lo, least, parity, wide = [], [], [], [], [], []
            for s in _sets(b.column(2)):
                x, y = _digest(s)
                n.append(len(s))
                hi.append(x)
                lo.append(y)
                least.append(s[:PROBES].view(np.int64))
                parity.append(parity_bits(s, PARITY_BITS))
                wide.append(parity_bits(s, max(PARITY_BITS, 1 << (2 * len(s)).bit_length())) if 2 * len(s) >= PARITY_BITS else parity[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(least, pa.list_(pa.int64())), pa.array(parity, pa.binary()), pa.array(wide, pa.binary())], ["doc_id", "h", "n", "hi", "lo", "least", "parity", "wide"])

    return _keyed(docs).mapInArrow(measure, f"doc_id {id_type}, h long, {PROFILE}")


def numbered_sets(prof: DataFrame) -> DataFrame:
    """The distinct sets under a number ``sid``, with the least ``doc_id, h`` that has each, kept."""
    full = prof.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    sets = full.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "h")).alias("home"), *(F.first(c).alias(c) for c in ("n", "least", "parity", "wide")))
    return held(sets.select(F.monotonically_increasing_id().alias("sid"), "home.doc_id", "home.h", "hi", "lo", "n", "least", "parity", "wide"))


def shingle_order(docs: DataFrame, bits: int = ORDER_BITS, piece: int = 1 << 14) -> np.ndarray:
    """Counts of all shingles in 2**bits hashed counters, summed piece by piece of the counter array."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for b in batches:
            for _, _, words in W.tokens(b.column(0)):
                total += np.bincount((W.grams(words, SHINGLE_WORDS).hashes & W.U64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        for k in range(0, 1 << bits, piece):
            part = total[k : k + piece]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // piece]), pa.array([part.astype(np.uint32).tobytes()], pa.binary())], ["k", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}  # at most 2**bits counters
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                totals[k] = totals.get(k, 0) + np.frombuffer(x, np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], ["k", "counts"])

    out = np.zeros(1 << bits, np.int64)
    for r in docs.select("text").mapInArrow(count, "k long, counts binary").repartition("k").mapInArrow(add, "k long, counts binary").collect():
        out[r["k"] * piece : (r["k"] + 1) * piece] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(out, np.iinfo(np.uint32).max).astype(np.uint32)  # 4 MB, whatever the input


# -- exact comparison of pairs -------------------------------------------------


_WORD, _BIT = "_place div 64", "shiftleft(1L, cast(_place % 64 as int))"


def _place(*columns: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), *columns), F.lit(1 << FILTER_BITS)).alias("_place")


def _filter_words(keys: DataFrame) -> DataFrame:
    """A Bloom filter of the rows of ``keys``: at most 2**(FILTER_BITS - 6) words of 64 bits, 1 MB of bits however many there are."""
    return keys.select(_place(*keys.columns)).select(F.expr(_WORD).alias("_word"), F.expr(_BIT).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def _marked(docs: DataFrame, keys: DataFrame) -> DataFrame:
    filled = F.broadcast(_filter_words(keys))
    return docs.withColumn("_place", _place(*keys.columns)).withColumn("_word", F.expr(_WORD)).join(filled, "_word", "left")


def _wanted(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` that may be among ``keys``; the filter keeps most other texts from being shuffled."""
    return _marked(docs, keys).where(F.col("_bits").bitwiseAND(F.expr(_BIT)) != 0).select(*docs.columns)


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def exact_overlaps(docs: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, common, linked`` for the rows of ``pairs(a, b)``, from whole texts.

    One shuffle brings each text to its pairs, a second brings the texts of
    the ``b`` of a pair to the text of ``a``, which comes first and is held
    alone; the others stream by.  An ``a`` with many pairs is dealt to
    several groups of about ``GROUP_PAIRS``.
    """
    pairs = pairs.distinct()
    busy = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP_PAIRS).cast("int").alias("groups"))
    dealt = pairs.join(busy, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int"))
    ends = dealt.select(F.col("b").alias("sid"), F.col("a").alias("at"), "part").unionByName(busy.select(F.col("a").alias("sid"), F.col("a").alias("at"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part")))
    ends = held(ends.join(sets.select("sid", "doc_id", "h"), "sid"))
    # A text that many rows repeat is sent once.
    texts = _wanted(_keyed(docs), ends.select("doc_id", "h")).dropDuplicates(["doc_id", "h"])
    rows = texts.join(ends, ["doc_id", "h"]).select("at", "sid", (F.col("sid") != F.col("at")).alias("second"), "text", "part")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = None, np.zeros(0, np.uint64)
        for b in batches:
            found = []
            for x, y, second, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), _sets(b.column(3)), strict=True):
                if not second:
                    at, first = x, s
                elif x == at and len(s):
                    common = len(np.intersect1d(first, s, assume_unique=True))
                    found.append((x, y, common, 100 * common >= PERCENT * (len(first) + len(s) - common)))
            cols = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["a", "b", "common", "linked"])

    return rows.repartition("at", "part").sortWithinPartitions("at", "part", "second").mapInArrow(compare, "a long, b long, common long, linked boolean")


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b)`` whose sizes fit and whose parity bits differ in no more buckets than linked sets can.

    The wide bits of sets that are in no pair are not shuffled.
    """
    pairs = held(pairs.select("a", "b"))
    sets = _wanted(sets.select("sid", "n", "wide"), pairs.select(F.explode(F.array("a", "b")).alias("sid")))
    side = lambda x: sets.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}"))
    known = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))

    @F.arrow_udf("long")
    def apart(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([odd_buckets(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.int64())

    return known.where((100 + PERCENT) * apart("wa", "wb") <= (100 - PERCENT) * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb")


# -- components ----------------------------------------------------------------


def _stars(edges: DataFrame) -> bool:
    """Whether ``edges(u, v)``, u > v, are stars: each u has one v, and no v is a u."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    return is_empty(ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 OR (ups = 1 AND least = 0)"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id, comp``: the least id of each node's component, for ``nodes(id)`` and ``links(a, b)``.

    Each round links every node of a star to the least node it knows (large
    stars, then small ones); rounds are about the logarithm of the longest
    chain.  A round shuffles links only, not nodes without links.
    """
    edges = held(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not _stars(edges):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # Large star: a node's greater neighbours go to its least one.
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: the smaller neighbours and the node itself go to the least one.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = held(small)
    return nodes.join(edges.select(F.col("u").alias("id"), F.col("v").alias("comp")), "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


# -- the join ------------------------------------------------------------------


def _first_links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact ``a, b, common`` of links to the first set that shares one of a set's least hashes."""
    probes = sets.select("sid", F.explode("least").alias("g"))
    first = probes.groupBy("g").agg(F.min("sid").alias("a"), F.count("*").alias("m")).where("m > 1").select("g", "a")
    pairs = held(plausible(probes.join(first, "g").where("a <> sid").select("a", F.col("sid").alias("b")).distinct(), sets).select("a", "b"))
    if is_empty(pairs):
        return docs.sparkSession.createDataFrame([], "a long, b long, common long")
    return held(exact_overlaps(docs, pairs, sets).where("linked").select("a", "b", "common"))


def _index(docs: DataFrame, order: np.ndarray, ranges: int) -> DataFrame:
    """``token, name, pos``: the index lists with more than one set; an entry may come twice.

    A list entry names a set by ``NAME_BITS`` of its digest; several sets of
    one name are all candidates, which an exact comparison settles.  So does
    it for two shingles of a range that share 32 bits.  A position beyond 16
    bits is stored as the last one that fits, which only weakens the bound.
    """
    sent = docs.sparkSession.sparkContext.broadcast(order)
    mask = W.U64((1 << ORDER_BITS) - 1)
    hot_from = max(HOT_LEAST, HOT_MEANS * float(order.mean(dtype=np.float64)))

    def packed_rows(token: list, names: list, pos: list, hot: list, turn: int) -> pa.RecordBatch:
        """One row for each range that has an entry; its entries as arrays.  Hot entries go apart, under ``salt``."""
        t, salt = W.mix(np.concatenate(token)), np.where(np.concatenate(hot), turn, -1)
        r = (t >> W.U64(32)).astype(np.int64) * ranges >> 32
        by = np.lexsort((r, salt))
        t, r, salt, l, p = t[by].astype(np.uint32), r[by], salt[by], np.concatenate(names)[by], np.concatenate(pos)[by]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (salt[1:] != salt[:-1])
        cut = np.flatnonzero(new)
        ends = np.append(cut[1:], len(r))
        packed = [pa.array([x[a:z].tobytes() for a, z in zip(cut, ends, strict=True)], pa.binary()) for x in (t, l.astype(np.uint32), (l >> 32).astype(np.uint8), p)]
        return pa.RecordBatch.from_arrays([pa.array(r[cut]), pa.array(salt[cut]), *packed], ["r", "salt", "token", "low", "high", "pos"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, held, turn = sent.value, set(), 0, TaskContext.get().partitionId()
        rows: tuple[list, ...] = ([], [], [], [])
        for b in batches:
            for s in _sets(b.column(0)):
                name = _digest(s)
                if len(s) and name not in seen:  # a task sends copies of a set once
                    seen.add(name)
                    p = prefix_length(len(s))
                    rank = counts[s & mask]
                    if p < len(s):
                        near = np.argpartition(rank, p - 1)
                        near = np.flatnonzero(rank <= rank[near[p - 1]])  # with all ties of the last rank
                    else:
                        near = np.arange(len(s))
                    near = near[np.lexsort((s[near], rank[near]))[:p]]
                    for to, x in zip(rows, (s[near], np.full(p, name[1] & ((1 << NAME_BITS) - 1)), np.minimum(np.arange(p), 65535).astype(np.uint16), rank[near] > hot_from), strict=True):
                        to.append(x)
                    held += p
                    if held > PACK_ENTRIES:
                        yield packed_rows(*rows, turn)
                        rows, held, turn = ([], [], [], []), 0, turn + 1
        if held:
            yield packed_rows(*rows, turn)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of tokens that several sets have.  Of a range only the distinct tokens are held, each with its first entry."""
        at, known = None, None
        for b in batches:
            r, salt = b.column(0).to_numpy(), b.column(1).to_numpy()
            cut = np.flatnonzero(np.diff(r, prepend=-1) | np.diff(salt >= 0, prepend=-1))
            for a, z in zip(cut, np.append(cut[1:], len(r)), strict=True):
                t, low, high, pos = (np.frombuffer(b"".join(b.column(k).slice(a, z - a).to_pylist()), kind) for k, kind in ((2, np.uint32), (3, np.uint32), (4, np.uint8), (5, np.uint16)))
                l = low.astype(np.int64) | high.astype(np.int64) << 32
                by = np.lexsort((pos, l, t))
                t, l, pos = t[by], l[by], pos[by].astype(np.int64)
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (l[1:] != l[:-1]) | (pos[1:] != pos[:-1])  # copies of a set say the same
                t, l, pos = t[new], l[new], pos[new]
                if salt[a] < 0:
                    if r[a] != at:
                        at, known = r[a], (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
                    t, l, pos, known = _several(t, l, pos, known)
                if len(t):
                    yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int64) + (int(r[a]) << 32)), pa.array(l), pa.array(pos)], ["token", "name", "pos"])

    packed = docs.select("text").mapInArrow(pack, "r long, salt long, token binary, low binary, high binary, pos binary")
    return packed.repartition("r", "salt").sortWithinPartitions("r", "salt").mapInArrow(shared, "token long, name long, pos long")


def _several(t: np.ndarray, l: np.ndarray, pos: np.ndarray, known: tuple) -> tuple:
    """Entries (sorted by token, name) whose token has more names than one, here or in ``known``, and the new ``known``.

    ``known`` is (tokens, name, position) of the first entry of each token seen; name -1 once the token is known to be shared.
    """
    kt, kname, kpos = known
    start = np.flatnonzero(np.diff(t.astype(np.int64), prepend=-1))
    size = np.diff(np.append(start, len(t)))
    tokens, first, last = t[start], l[start], l[start + size - 1]
    at = np.minimum(np.searchsorted(kt, tokens), max(len(kt) - 1, 0))
    hit = kt[at] == tokens if len(kt) else np.zeros(len(tokens), bool)
    old = np.where(hit, kname[at], -2) if len(kt) else np.full(len(tokens), -2)
    many = (first != last) | (old == -1) | ((old >= 0) & ((old != first) | (old != last)))
    held = np.flatnonzero(many & (old >= 0))  # their first entry has waited
    out = np.repeat(many, size)
    t2, l2, p2 = np.concatenate((t[out], tokens[held])), np.concatenate((l[out], old[held])), np.concatenate((pos[out], kpos[at[held]] if len(held) else pos[:0]))
    kname = kname.copy()
    kname[at[hit & many]] = -1
    fresh = ~hit
    nt, nn, np_ = np.concatenate((kt, tokens[fresh])), np.concatenate((kname, np.where(many, -1, first)[fresh])), np.concatenate((kpos, pos[start][fresh]))
    by = np.argsort(nt, kind="stable")
    return t2, l2, p2, (nt[by], nn[by], np_[by])


def _fitting(key: np.ndarray, side: np.ndarray, n: np.ndarray, pos: np.ndarray, comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one key, different sides (or both of side 0) and different components whose sizes and positions allow a link.

    Rows stand by key, then size; rows that stand d apart meet for d = 1, 2, ..., and one that meets too large a set is done.
    """
    i, d = np.arange(len(n)), 0
    while len(i):
        d += 1
        i = i[i + d < len(n)]
        j = i + d
        on = (key[i] == key[j]) & (100 * n[i] >= PERCENT * n[j])
        i, j = i[on], j[on]
        fit = (comp[i] != comp[j]) & ((side[i] != side[j]) | (side[i] == 0))
        fit &= np.minimum(n[i] - pos[i], n[j] - pos[j]) + np.minimum(pos[i], pos[j]) >= needed_overlap(n[i], n[j])
        yield i[fit], j[fit]


_BLOCKS = ("block", "lead", "open", "token", "n", "pos", "sid", "comp")


def _blocks(entries: DataFrame) -> DataFrame:
    """Entries under the ``block`` of their list that they stand in, kept; lists end up in blocks of at most ``LIST_BLOCK``.

    A list that has one block, all in one task, is closed: entries without a possible partner in it are dropped at once.
    Blocks of other lists are ``open``: they still have to meet.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, began, last = TaskContext.get().partitionId() << 32, None, True, None
        for batch in _and_none(batches):
            if batch is not None:
                # token, band, comp, pos, sid, n: sorted by all but the last
                new = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)])
                rows = new if rows is None else np.concatenate((rows, new))
            if rows is None or not len(rows):
                continue
            again = (rows[1:] == rows[:-1]).all(axis=1)  # an entry that came twice
            rows = rows[np.append(last is None or (rows[0] != last).any(), ~again)]
            if not len(rows):
                continue
            start = np.flatnonzero(np.diff(rows[:, 0], prepend=rows[0, 0] - 1))
            if batch is None:
                end = len(rows)
            else:  # the last list may go on: only whole blocks of it are cut
                end = int(start[-1] + (len(rows) - start[-1]) // LIST_BLOCK * LIST_BLOCK)
            if not end:
                continue
            start = start[start < end]
            size = np.diff(np.append(start, end))
            rank = np.arange(end) - np.repeat(start, size)
            opened = size > LIST_BLOCK
            opened[0] |= began  # first list of the task, or one that goes on
            opened[-1] |= batch is None or end > start[-1] and end < len(rows) and rows[end, 0] == rows[end - 1, 0] or end == len(rows)
            opened = np.repeat(opened, size)
            number = np.cumsum(rank % LIST_BLOCK == 0)
            done = rows[:end]
            # What stands before ``end`` may be of the list that comes next.
            began = end == len(rows) or rows[end, 0] == rows[end - 1, 0]
            rows, last = rows[end:], rows[end - 1]
            keep = opened.copy()
            closed = np.flatnonzero(~opened)
            closed = closed[np.lexsort((done[closed, 5], number[closed]))]
            for i, j in _fitting(number[closed], np.zeros(len(closed), np.int8), done[closed, 5], done[closed, 3], done[closed, 2]):
                keep[closed[i]] = keep[closed[j]] = True
            kept, number = done[keep], number[keep]
            lead = np.zeros(0, np.int64)
            if len(kept):
                at = np.flatnonzero(np.diff(number, prepend=0))
                lead = np.repeat(np.minimum.reduceat(kept[:, 4], at), np.diff(np.append(at, len(kept))))
            out = [pa.array(x) for x in (block + number, lead, opened[keep], *(kept[:, k] for k in (0, 5, 3, 4, 2)))]
            block += end  # no less than the blocks cut
            yield pa.RecordBatch.from_arrays(out, list(_BLOCKS))

    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / PERCENT)).alias("band")
    by = ["token", "band", "comp", "pos", "sid"]
    placed = entries.select("token", band, "comp", "pos", "sid", "n").repartitionByRange(*by).sortWithinPartitions(*by)
    return held(placed.mapInArrow(cut, "block long, lead long, open boolean, token long, n long, pos long, sid long, comp long"))


def _list_pairs(blocks: DataFrame, comps: DataFrame, sets: DataFrame, best: bool) -> DataFrame:
    """Pairs ``a, b`` of different ``comps(id, comp)`` that share a list and pass sizes, positions and parity.

    With ``best``, each task gives only a least spanning forest of what it finds: pairs, the nearest by parity first, that
    tie components together which no nearer pairs tie.  These are fewer than the components that the task meets.
    """
    known = sets.select("sid", "parity").join(comps.withColumnRenamed("id", "sid"), "sid")
    opened = blocks.where("open").drop("comp").join(comps.withColumnRenamed("id", "sid"), "sid")
    about = opened.groupBy("token", "block").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.max("pos").alias("far"))
    x, y = about.alias("x"), about.alias("y")
    apart = (F.least("x.c0", "y.c0") != F.greatest("x.c1", "y.c1")) & (100 * F.col("x.n1") >= PERCENT * F.col("y.n0")) & (100 * F.col("y.n1") >= PERCENT * F.col("x.n0"))
    reach = (100 + PERCENT) * (F.least("x.rest", "y.rest") + F.least("x.far", "y.far")) >= PERCENT * (F.col("x.n0") + F.col("y.n0"))
    meet = x.join(y, F.col("x.token") == F.col("y.token")).where((F.col("x.block") <= F.col("y.block")) & apart & reach).select(F.col("x.block").alias("x"), F.col("y.block").alias("y"))
    end = lambda block, side: F.struct(F.col(block).alias("block"), F.lit(side).alias("side"))
    sides = meet.select("x", "y", F.explode(F.when(F.col("x") == F.col("y"), F.array(end("x", 0))).otherwise(F.array(end("x", 1), end("y", 2)))).alias("s")).select("x", "y", "s.*")
    own = F.col("block")
    dealt = blocks.where("not open").select(own.alias("x"), own.alias("y"), "lead", F.lit(0).alias("side"), "n", "pos", "sid").unionByName(blocks.where("open").select("block", "n", "pos", "sid").join(sides, "block").drop("block").withColumn("lead", F.col("x")))
    rows = dealt.join(known, "sid").select("x", "y", "side", "n", "pos", "sid", "comp", "parity", "lead")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, tree = None, set(), np.zeros((0, 5), np.int64)

        def absorb(found: list, new: set) -> None:
            """Pairs as rows (distance, components, sets) join the task's forest, or each that is not known goes to ``new``."""
            nonlocal tree
            if best and found:
                tree = _forest(np.concatenate((tree, *found)))
            elif found:
                fresh = set(map(tuple, np.unique(np.concatenate(found)[:, 3:], axis=0).tolist())) - seen
                seen.update(fresh)
                new |= fresh

        for batch in _and_none(batches):
            if batch is not None:
                cols = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(7)]
                bits = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint64).reshape(batch.num_rows, PARITY_BITS // 64)
                held = [*cols, bits] if held is None else [np.concatenate(z) for z in zip(held, [*cols, bits], strict=True)]
            if held is None or not len(held[0]):
                continue
            new = np.append(True, (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
            end = len(new) if batch is None else int(np.flatnonzero(new)[-1])  # the last group may go on in the next batch
            key = np.cumsum(new)[:end]
            _, _, side, n, pos, sid, comp, bits = (z[:end] for z in held)
            held = [z[end:] for z in held]
            found, size, new = [], 0, set()
            for i, j in _fitting(key, side, n, pos, comp):
                odd = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
                fit = (100 + PERCENT) * odd <= (100 - PERCENT) * (n[i] + n[j])
                i, j, odd = i[fit], j[fit], odd[fit]
                a, b = sid[i], sid[j]
                apart = (1_000_000 * _differing(odd) / (n[i] + n[j])).astype(np.int64)
                found.append(np.column_stack((apart, np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j]), np.minimum(a, b), np.maximum(a, b))))
                size += len(i)
                if size > FOUND_PAIRS:  # many pairs are folded before more are made
                    absorb(found, new)
                    found, size = [], 0
            absorb(found, new)
            if len(seen) > REMEMBERED_PAIRS:
                seen.clear()
            yield _pair_batch(new)
        yield _pair_batch(set(map(tuple, tree[:, 3:].tolist())))

    dealt_to = F.pmod(F.xxhash64("x", "y"), F.lit(LEAD_TASKS))
    return rows.repartition("lead", dealt_to).sortWithinPartitions("x", "y", "n").drop("lead").mapInArrow(find, "a long, b long").distinct()


def _forest(rows: np.ndarray) -> np.ndarray:
    """Of rows (distance, component, component, set, set) a least spanning forest of the components; equal distances by the other columns."""
    rows = rows[np.lexsort(rows.T[::-1])]
    _, first = np.unique(rows[:, 1:3], axis=0, return_index=True)  # the nearest of the same two
    rows, above, kept = rows[np.sort(first)], {}, []

    def top(c: int) -> int:
        while (up := above.get(c, c)) != c:
            above[c] = c = above.get(up, up)
        return c

    for k, (c, d) in enumerate(rows[:, 1:3].tolist()):
        if (x := top(c)) != (y := top(d)):
            above[x] = y
            kept.append(k)
    return rows[kept]


def _pair_batch(pairs: set) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _answers(docs: DataFrame, pairs: DataFrame, linked: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact links ``a, b`` that join the components of ``pairs(a, b, na, nb)``, each derived from its representatives where it can be.

    A set's representative is the linked set with which it shares most;
    ``own`` counts the shingles that it has beyond it.  Representatives are
    compared first.  Where they link, their members are in one component.
    Where they share c, members share no more than c and what both have of
    their own, so most pairs are answered without their texts.
    """
    best = linked.groupBy(F.col("b").alias("sid")).agg(F.max(F.struct("common", F.col("a").alias("rep"))).alias("best"))
    stands = sets.select("sid", "n").join(best, "sid", "left").select("sid", F.coalesce("best.rep", "sid").alias("rep"), F.when(F.col("best").isNull(), 0).otherwise(F.col("n") - F.col("best.common")).alias("own"))
    of = lambda x: stands.select(F.col("sid").alias(x), F.col("rep").alias(f"r{x}"), F.col("own").alias(f"o{x}"))
    named = held(pairs.join(of("a"), "a").join(of("b"), "b").withColumns({"p": F.least("ra", "rb"), "q": F.greatest("ra", "rb")}))
    cores = held(exact_overlaps(docs, named.select(F.col("p").alias("a"), F.col("q").alias("b")), sets))
    left = named.join(cores.select(F.col("a").alias("p"), F.col("b").alias("q"), "common", "linked"), ["p", "q"]).where("not linked")
    is_core = (F.least("a", "b") == F.col("p")) & (F.greatest("a", "b") == F.col("q"))
    open_pairs = held(left.where(~is_core & ((100 + PERCENT) * (F.col("common") + F.col("oa") + F.col("ob")) >= PERCENT * (F.col("na") + F.col("nb")))).select("a", "b"))
    links = cores.where("linked").select("a", "b")
    return links if is_empty(open_pairs) else links.unionByName(exact_overlaps(docs, open_pairs, sets).where("linked").select("a", "b"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``.

    A null or empty text has no shingle and links with nothing; its component
    is itself.  A null id takes no part in links and has a null component.
    Rows with equal ids are one document to the links, with the links of all
    of its texts; each comes back.  Ids may be of any type with an order.
    Extra columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    prof = held(profiles(docs))
    sets = numbered_sets(prof)
    linked = _first_links(docs, sets)
    comps = components(sets.select(F.col("sid").alias("id")), linked)
    entries_total = sets.agg(F.sum((F.col("n") / 4 + 1).cast("long"))).first()[0] or 0
    ranges = max(1, math.ceil(entries_total / RANGE_ENTRIES))
    names = sets.select(F.col("lo").bitwiseAND(F.lit((1 << NAME_BITS) - 1)).alias("name"), "sid", "n").join(comps.withColumnRenamed("id", "sid"), "sid")
    entries = _index(docs, shingle_order(docs), ranges).join(names, "name").select("token", "sid", "comp", "n", "pos")
    blocks = _blocks(entries)
    # First the nearest pairs that tie components together, which merges most of those that link; then all pairs that are left.
    nearest = held(plausible(_list_pairs(blocks, comps, sets, best=True), sets).select("a", "b"))
    links = linked.select("a", "b")
    if not is_empty(nearest):
        links = held(links.unionByName(exact_overlaps(docs, nearest, sets).where("linked").select("a", "b")))
        merged = components(sets.select(F.col("sid").alias("id")), links)
        pairs = held(plausible(_list_pairs(blocks, merged, sets, best=False), sets).join(nearest, ["a", "b"], "left_anti"))
        if not is_empty(pairs):
            links = links.unionByName(_answers(docs, pairs, linked, sets))
    # A set's node is the least id that has it; an id with several texts links their nodes.
    home = lambda x: sets.select(F.col("sid").alias(x), F.col("doc_id").alias(f"d{x}"))
    full = prof.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "hi", "lo")
    same_id = full.join(sets.select("hi", "lo", F.col("doc_id").alias("b")), ["hi", "lo"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    between = links.join(home("a"), "a").join(home("b"), "b").select(F.col("da").alias("a"), F.col("db").alias("b"))
    final = components(full.select(F.col("doc_id").alias("id")).distinct(), between.unionByName(same_id))
    return prof.select("doc_id", F.col("n").alias("n_shingles")).join(final, F.col("doc_id") == F.col("id"), "left").select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return jaccard_components(load(spark, sf_dir, "documents"))


def near_duplicate_representatives(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``: that of the least id.  All columns stay.

    Only rows that a fixed-size filter takes for droppable are shuffled, to
    be settled exactly; the others pass where they are.  Rows with a null id
    stay.  Of rows with one id the least stays, by its columns in order.
    """
    found = held(jaccard_components(docs))
    repeated = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("m"), F.min("component_id").alias("c")).where((F.col("m") > 1) | (F.col("c") != F.col("doc_id")))
    doubtful = held(repeated.select("doc_id", (F.col("c") != F.col("doc_id")).alias("drop")))
    # The rows travel as one struct, so their column names can't clash with those used here.
    rows = docs.select("doc_id", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    marked = _marked(rows, doubtful.select("doc_id"))
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.expr(_BIT)) != 0, F.lit(False))
    doubtful = doubtful.withColumnRenamed("doc_id", "id")
    settled = marked.where(hit).select("doc_id", "row").join(doubtful, F.col("doc_id") == F.col("id"), "left").where(~F.coalesce("drop", F.lit(False)))
    single = settled.where(F.col("id").isNull()).select("row").unionByName(settled.where(F.col("id").isNotNull()).groupBy("doc_id").agg(F.min("row").alias("row")).select("row"))
    return marked.where(~hit).select("row").unionByName(single).select("row.*")
