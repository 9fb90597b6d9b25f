"""Vectorised words and shingles of an Arrow text column.

The helpers look at UTF-8 bytes in place, so one numpy call covers thousands
of documents and no Python string is made for a word.  A word is known by a
64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; a longer text goes alone.
CHUNK_BYTES = 500_000

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_MULT = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_MULT), -1, 2**64))
_ORDER = (_RNG.integers(1, 2**63, 16, dtype=np.uint64) << U64(1)) | U64(1)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_VALUE = _BYTE_VALUE[_FOLD]

#: 0 separates; a run of one other class makes a token.
WHITESPACE = np.ones(256, dtype=np.uint8)
WHITESPACE[[9, 10, 11, 12, 13, 32]] = 0
#: Letters, digits and non-ASCII bytes are one class, visible ASCII marks another.
LETTERS_AND_MARKS = np.full(256, 2, dtype=np.uint8)
LETTERS_AND_MARKS[:33] = 0
LETTERS_AND_MARKS[127] = 0
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    LETTERS_AND_MARKS[_lo:_hi] = 1

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_MULT, _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


@dataclass
class Words:
    """Words of some documents: hash of each, and ``offsets[i]:offsets[i+1]`` for document i."""

    hashes: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the offset of each row; null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes together."""
    row, rows = 0, len(off) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield row, min(end, rows)
        row = end


def _tokens(data: np.ndarray, off: np.ndarray, classes: np.ndarray) -> Words:
    n = len(data)
    kind = classes[data]
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[off[off <= n]] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = kind[starts] != 0
    starts, ends = starts[keep], ends[keep]
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * power[:n], out=total[1:])
    h = mix((total[ends] - total[starts]) * inverse[starts])
    return Words(h, np.searchsorted(starts, off))


def tokens(col: pa.Array, classes: np.ndarray = WHITESPACE) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) by ranges of rows; A-Z count as a-z."""
    data, off = text_bytes(col)
    for a, b in slices(off):
        part = off[a : b + 1] - off[a]
        if part[-1] == 0:
            yield a, b, Words(np.zeros(0, np.uint64), np.zeros(b - a + 1, np.int64))
        else:
            yield a, b, _tokens(data[off[a] : off[b]], part, classes)


def grams(words: Words, n: int) -> Words:
    """Every run of n words of one document."""
    count = np.diff(words.offsets)
    kept = np.maximum(count - n + 1, 0)
    new = np.concatenate(([0], np.cumsum(kept)))
    if not new[-1]:
        return Words(np.zeros(0, np.uint64), new)
    at = np.repeat(words.offsets[:-1] - new[:-1], kept) + np.arange(new[-1])
    h = np.zeros(new[-1], dtype=np.uint64)
    for k in range(n):
        h += words.hashes[at + k] * _ORDER[k]
    return Words(mix(h), new)


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each document; fewer words make one shingle."""
    full = grams(words, n)
    out = []
    for i in range(len(words)):
        a, b = words.offsets[i], words.offsets[i + 1]
        if b - a >= n:
            out.append(np.unique(full.hashes[full.offsets[i] : full.offsets[i + 1]]))
        elif b > a:
            with np.errstate(over="ignore"):
                h = np.sum(words.hashes[a:b] * _ORDER[: b - a], dtype=np.uint64) + U64(b - a)
            out.append(mix(np.array([h], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
