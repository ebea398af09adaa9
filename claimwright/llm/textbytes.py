"""Whole-batch views of a text column: words, hashes and slices over raw UTF-8.

Arrow hands a string column over as one byte buffer with offsets.  The helpers here
work on that buffer with numpy, so no Python object is made per word or character.
A word is a maximal run of ``[0-9A-Za-z]`` and non-ASCII bytes, with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes worked on at once; a longer document forms a slice of its own.
SLICE_BYTES = 1 << 19

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True
LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit over the output."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64; only those of a usual slice are kept."""
    kept = _powers if n <= SLICE_BYTES + 1 else {}
    if len(kept.get("up", ())) < n:
        for name, base in (("up", _P), ("down", _P_INV)):
            step = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            step[0] = 1
            kept[name] = np.cumprod(step, dtype=np.uint64)
    return kept["up"][:n], kept["down"][:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most `limit` bytes, or one row each."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop
        start = stop


class Words:
    """The words of some documents that stand in one buffer.

    doc, start, end, hash: one entry per word, in order; `sums` and `down` hash any
    stretch of the buffer (see `stretch`).
    """

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        self.docs = len(offsets) - 1
        self.bytes = len(data)
        word = WORD_BYTE[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        heads = offsets[:-1][np.diff(offsets) > 0]
        first[heads] = word[heads]
        tails = heads[1:] - 1
        last[tails] = word[tails]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        up, self.down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        values = LOWER_BYTE[data].astype(np.uint64)
        values += np.uint64(1)
        values *= up[:-1]
        np.cumsum(values, out=sums[1:])
        self.sums = sums
        self.hash = self.stretch(self.start, self.end)

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the lower-cased bytes of each [start, end)."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.docs)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of each run of k words; a document of fewer words has one of all its words."""
    counts = words.per_doc()
    heads = np.concatenate([[0], np.cumsum(counts)])
    n = len(words.hash)
    rolled = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        rolled[: n - j] = (rolled[: n - j] + words.hash[j:]) * np.uint64(_P)
    left = heads[words.doc + 1] - np.arange(n)
    keep = left >= k
    short = np.flatnonzero((counts > 0) & (counts < k))
    doc, value = words.doc[keep], mix(rolled[keep])
    if len(short):
        tail = np.zeros(len(short), np.uint64)
        for j in range(k):
            has = counts[short] > j
            tail[has] = (tail[has] + words.hash[heads[short[has]] + j]) * np.uint64(_P)
        doc = np.concatenate([doc, short])
        value = np.concatenate([value, mix(tail + counts[short].astype(np.uint64))])
    return doc, value
