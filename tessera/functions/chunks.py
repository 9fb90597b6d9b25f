"""Table-generating text functions: chunks with offsets, log windows, salient slices, hash embeddings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TARGET, OVERLAP = 1500, 150
_SENTENCE = re.compile(r"[.!?]\s+(?=[A-Z0-9\"'(\[])")


def cut_points(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most ``target`` characters: cut at the last paragraph, line or sentence end of the window's second half, else hard."""
    out, start = [], 0
    while len(text) - start > target:
        low, high = start + target // 2, start + target
        end = text.rfind("\n\n", low, high) + 2
        if end < low + 2:
            end = text.rfind("\n", low, high) + 1
        if end < low + 1:
            end = max((m.end() for m in _SENTENCE.finditer(text, low, high)), default=high)
        out.append((start, end))
        start = max(end - overlap, start + 1)
    if text[start:].strip():
        out.append((start, len(text)))
    return out


def chunk_spans(text: Column) -> Column:
    """array<struct<start, end>> of the chunks of a text."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def spans(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for col in texts:
            yield pa.array([[{"start": a, "end": b} for a, b in cut_points(x or "")] for x in col.to_pylist()], kind)

    return spans(text)


def embed(text: str) -> np.ndarray | None:
    """A deterministic stand-in for an embedding service: 32 signed word counts, unit length; None for no word."""
    v = np.zeros(32)
    for w in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little")
        v[h % 32] += 1 if h >> 16 & 1 else -1
    n = np.linalg.norm(v)
    return (v / n).astype(np.float32) if n else None


def embedding(text: Column, embedder=embed) -> Column:
    """Vectors in Arrow batches; ``embedder`` takes one text."""

    @F.arrow_udf("array<float>")
    def vectors(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in texts:
            yield pa.array([embedder(x or "") for x in col.to_pylist()], pa.list_(pa.float32()))

    return vectors(text)


def log_windows(text: Column, lines: int = 40, overlap: int = 5) -> Column:
    """(first line, joined lines) of windows of a log, overlapping."""
    parts = F.split(text, "\n")
    starts = F.sequence(F.lit(0), F.greatest(F.size(parts) - 1 - overlap, F.lit(0)), F.lit(lines - overlap))
    return F.transform(starts, lambda s: F.struct(s.alias("line"), F.array_join(F.slice(parts, s + 1, lines), "\n").alias("text")))
