"""Word shingles of whole texts as 64-bit hashes, in numpy over Arrow buffers.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D after
lower-casing A-Z.  A text's set holds the distinct windows of five words; a
text of one to four words has the one window of all its words, and a text
without words the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text that one vectorised pass covers at least, unless fewer are left; bounds its memory together with the longest text.
CHUNK = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20260101))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(1, 1 << 62)) * 2 + 1
_SEAT = [np.uint64(int(x) * 2 + 1) for x in _RNG.integers(1, 1 << 62, WIDTH)]
_ROT = [np.uint64(r) for r in (0, 13, 29, 41, 53)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, known: list = [np.ones(1, dtype=np.uint64)]) -> np.ndarray:  # noqa: B006  grows once a process
    while len(known[0]) < n:
        step = np.uint64(pow(_BASE, len(known[0]), 1 << 64))
        known[0] = np.concatenate([known[0], known[0] * step])
    return known[0]


def _rotated(x: np.ndarray, r: np.uint64) -> np.ndarray:
    return x if not r else (x << r) | (x >> (np.uint64(64) - r))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive texts, and how many words each text has.

    ``data`` holds the texts' bytes, ``bounds`` their n + 1 edges in it.
    """
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, starts)
    lengths = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    terms = _BYTE[_FOLD[data[at]]] * _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64)), np.diff(np.searchsorted(starts, bounds))


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Ascending distinct shingle hashes of one text's word hashes."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, WIDTH)
    total = words[: n - k + 1] * _SEAT[0] + np.uint64(k)
    for i in range(1, k):
        total = mix(total) + _rotated(words[i : n - k + 1 + i], _ROT[i]) * _SEAT[i]
    return np.unique(mix(total))


def texts_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Bytes and edges of chunks of whole texts of a string column, with the rows they span; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(edges, edges[row] + CHUNK, side="right")) - 1))
        yield data[edges[row] : edges[end]], edges[row : end + 1] - edges[row], row, end
        row = end


def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of every row of a string column, in order."""
    for data, bounds, _, _ in texts_of(column):
        hashes, counts = word_hashes(data, bounds)
        at = 0
        for c in counts.tolist():
            yield shingle_set(hashes[at : at + c])
            at += c
