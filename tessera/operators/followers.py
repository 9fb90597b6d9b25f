"""Distinct ids that follow an id on the same key within a span, counted without a row for each pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of either table that one task holds, about, and the least number of ways that the later ones are dealt.
MOST_FIRST, MOST_LATER, LEAST_WAYS = 2_000_000, 1_000_000, 12


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Each value's number and the values; null is one of them."""
    coded = pc.dictionary_encode(column, null_encoding="encode").combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _spans(first: pa.Table, later: pa.Table, span: int) -> tuple[np.ndarray, ...]:
    """For each first row (by id): id's number, and from and to which later row (sorted by key, time) it has followers; ids; the later rows' id numbers."""
    keys, names = _codes(pa.chunked_array([*first["k"].chunks, *later["k"].chunks], later["k"].type))
    who, ids = _codes(first["id"])
    what, found = _codes(later["id"])
    k, at = keys[: len(who)], first["at"].to_numpy()
    kl, al = keys[len(who) :], later["at"].to_numpy()
    order = np.lexsort((al, kl))
    kl, al, what = kl[order], al[order], what[order]
    a, z = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
    by = np.argsort(k, kind="stable")
    cut, cut_later = np.searchsorted(k[by], np.arange(len(names) + 1)), np.searchsorted(kl, np.arange(len(names) + 1))
    for n in np.flatnonzero((np.diff(cut) > 0) & (np.diff(cut_later) > 0)):
        rows, times, start = by[cut[n] : cut[n + 1]], al[cut_later[n] : cut_later[n + 1]], cut_later[n]
        a[rows], z[rows] = start + np.searchsorted(times, at[rows], "right"), start + np.searchsorted(times, at[rows] + span, "right")
    some = np.flatnonzero(z > a)
    some = some[np.lexsort((a[some], who[some]))]
    return who[some], a[some], z[some], ids, what, found


def followers(first: DataFrame, later: DataFrame, span: int) -> DataFrame:
    """``id, n, first, total``: of each id of ``first(id, k, at)`` how many distinct ids of ``later(id, k, at)`` have its key within ``span`` after it, the least of them and their sum.

    Both tables are dealt by id, so the counts of a share of the later ids add
    up: each share of the first table meets each of the later one.  A task
    keeps one mark for each of its later ids and goes through the followers of
    one id after another; no pair becomes a row.  Rows of one id lie in one
    share.  Keys and times may not be null; a null id is an id, but has no
    place in the least one and the sum.
    """
    ways = lambda df, most, least: max(1, least, -(-df.count() // most))
    rows_of, ways_of = ways(first, MOST_FIRST, 1), ways(later, MOST_LATER, LEAST_WAYS)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    share = lambda n, name: F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(n)).cast("int").alias(name)
    left = first.select("id", "k", "at", share(rows_of, "x"), every(ways_of, "y")).distinct()
    right = later.select("id", "k", "at", share(ways_of, "y"), every(rows_of, "x")).distinct()
    ids, counted = first.schema["id"].dataType.simpleString(), later.schema["id"].dataType.simpleString()

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        who, begin, end, ids, what, found = _spans(a, b, span)
        values, known = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), found.is_valid().to_numpy(zero_copy_only=False)
        marks, out = np.zeros(len(values), bool), []
        starts = np.flatnonzero(np.diff(who, prepend=-1))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(who)][: len(starts)], strict=True):
            for i, j in zip(begin[s:e].tolist(), end[s:e].tolist(), strict=True):
                marks[what[i:j]] = True
            hit = np.flatnonzero(marks)
            marks[hit] = False
            real = values[hit[known[hit]]]
            out.append((len(hit), int(real.min()) if len(real) else None, int(real.sum()) if len(real) else None))
        n, least, total = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"id": ids.take(pa.array(who[starts])), "n": pa.array(n, pa.int64()), "first": pa.array(least, pa.int64()).cast(found.type), "total": pa.array(total, pa.int64())})

    parts = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(count, f"id {ids}, n long, first {counted}, total long")
    return parts.groupBy("id").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("total").alias("total"))
