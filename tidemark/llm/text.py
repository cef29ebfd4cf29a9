"""Whole-batch text arithmetic in numpy, shared by the text operators.

Every function here works on the UTF-8 bytes of an Arrow string column without making one Python
object per word.  A word's hash is a polynomial in its bytes modulo 2**64 over a table of random
64-bit values, followed by a bit mixer; hashes of word sequences are built from the word hashes.
Two different words (or sequences) share a hash with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Chunks of this many bytes are hashed at a time, so that the work arrays stay in the cache.
CHUNK_BYTES = 1 << 18

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEQ = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A run of words that is hashed at a time is at most this long; only a longer single word goes through `_long_hash`.
RUN_BYTES = 2 * CHUNK_BYTES


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2**64, as many as a run of words needs."""
    inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
    up, down = np.full(RUN_BYTES + 1, _STEP), np.full(RUN_BYTES + 1, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers()


def _long_hash(raw: np.ndarray) -> np.ndarray:
    """The polynomial of one word of any length, run by run."""
    total, size = 0, 1 << 64
    for low in range(0, len(raw), RUN_BYTES):
        part = raw[low : low + RUN_BYTES]
        total += int((_BYTE_VALUE[LOWER[part]] * _UP[: len(part)]).sum(dtype=np.uint64)) * pow(int(_STEP), low, size)
    return np.array([total % size], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def separators(ranges: list[tuple[int, int]]) -> np.ndarray:
    """256 booleans, true for bytes that belong to words; `ranges` are the inclusive others."""
    word = np.ones(256, dtype=bool)
    for low, high in ranges:
        word[low : high + 1] = False
    return word


#: Words of [^\x20\x09-\x0D]+
SPACE_WORDS = separators([(0x20, 0x20), (0x09, 0x0D)])
#: Words of ASCII letters, digits and everything beyond ASCII.
ALNUM_WORDS = separators([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: Byte to byte, A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose bytes together are about `limit`; a longer document stands alone."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high
        low = high


class Words:
    """The words of documents [low, high): `first[i]:first[i + 1]` are those of the i-th."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, low: int, high: int, word: np.ndarray):
        base = int(offsets[low])
        raw = data[base : int(offsets[high])]
        edges = (offsets[low : high + 1] - base).astype(np.int64)
        inside = word[raw]
        begins, ends = inside.copy(), inside.copy()
        if len(raw):
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            at = edges[:-1][edges[:-1] < edges[1:]]
            begins[at] = inside[at]
            last = edges[1:][edges[:-1] < edges[1:]] - 1
            ends[last] = inside[last]
        self.begin = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.begin, edges)
        self.base, self._raw = base, raw
        self._sums: np.ndarray | None = None

    def _run(self, low: int, high: int) -> np.ndarray:
        """Sums of byte values times powers before each of the bytes low to high."""
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[LOWER[self._raw[low:high]]] * _UP[: high - low], out=sums[1:])
        return sums

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """A hash for each word, or for the first `longest` bytes of each."""
        begin, end = self.begin, self.end if longest is None else np.minimum(self.end, self.begin + longest)
        if len(self._raw) <= RUN_BYTES:
            if self._sums is None:
                self._sums = self._run(0, len(self._raw))
            return mix((self._sums[end] - self._sums[begin]) * _DOWN[begin])
        out, low = np.zeros(len(begin), np.uint64), 0
        while low < len(begin):
            at = int(begin[low])
            high = max(low + 1, int(np.searchsorted(end, at + RUN_BYTES, side="right")))
            if end[high - 1] - at > RUN_BYTES:
                out[low:high] = _long_hash(self._raw[at : end[low]])
            else:
                sums = self._run(at, int(end[high - 1]))
                out[low:high] = (sums[end[low:high] - at] - sums[begin[low:high] - at]) * _DOWN[begin[low:high] - at]
            low = high
        return mix(out)


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive word hashes; none if there are fewer words."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(len(words) - n + 1, np.uint64(n), dtype=np.uint64)
    for j in range(n):
        total += words[j : len(words) - n + 1 + j] * _SEQ[j]
    return mix(total)


def shingle_set(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; fewer words count as one shingle, none as no shingle."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    return np.unique(sequence_hashes(words, n if len(words) >= n else len(words)))


def each_document(column: pa.Array, word: np.ndarray = SPACE_WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes in order) for every row of a string column."""
    data, offsets = as_bytes(column)
    for low, high in chunks(offsets):
        found = Words(data, offsets, low, high, word)
        hashed, first = found.hashes(), found.first
        for i in range(high - low):
            yield low + i, hashed[first[i] : first[i + 1]]
