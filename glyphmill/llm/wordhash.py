"""Vectorised words and hashes of whole Arrow batches of texts, in numpy.

A word's hash is the sum of one scrambled value for each of its bytes, which
depends on the byte and on its place in the word, taken from prefix sums and
then mixed with the length. A polynomial in a fixed base modulo 2**64 won't do
for words: texts of 1,024 letters are known that collide in every odd base. A
window's hash is such a polynomial over its words' hashes; that needs runs of
over a thousand words to fail so, and windows here have at most some eighty.
No Python loop runs over words or texts.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once, unless one text is longer.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _values(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class Base:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were needed yet."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, CHUNK + 1)
            for name, x in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, x, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def sums(self, values: np.ndarray) -> np.ndarray:
        self.reach(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


WINDOW, WINDOW2 = Base(0xD1342543DE82EF95), Base(0x2545F4914F6CDD1D)
#: Values of a byte at each of the first places of a word; later places are scrambled when they occur.
NEAR = 64
BYTE_AT = _values(NEAR * 256, 7)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts of about ``limit`` bytes."""
    data, offsets = buffers(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    give_back()


def give_back() -> None:
    """Return freed memory to the system: Python workers live on for the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_starts(n: int, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(n + 1, bool)
    out[offsets] = True
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each text's first word (one more at the end)."""
    space, edge = SPACE[data], text_starts(len(data), offsets)
    word = ~space
    start, end = word.copy(), word.copy()
    start[1:] &= space[:-1] | edge[1:-1]
    end[:-1] &= space[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans that follow each other without overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lead = int(starts[0])
    place = np.arange(lead, len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    code = (place << 8) | data[lead:]
    values = BYTE_AT[np.minimum(code, NEAR * 256 - 1)]
    if len(far := np.flatnonzero(place >= NEAR)):
        values[far] = mix((code[far] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return mix(sums[ends - lead] - sums[starts - lead] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(hashes: np.ndarray, starts: np.ndarray, size: int | np.ndarray, base: Base = WINDOW, sums: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the windows of ``size`` words at ``starts``, which must lie within their texts."""
    sums = base.sums(hashes) if sums is None else sums
    return mix(base.spans(sums, starts, starts + size))


def unique_in(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (owner, value) pairs, sorted by owner and then value."""
    order = np.lexsort((values, owner))
    o, v = owner[order], values[order]
    keep = np.ones(len(o), bool)
    keep[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return o[keep], v[keep]
