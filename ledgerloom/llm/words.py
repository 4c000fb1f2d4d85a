"""Whole texts as arrays of word hashes, for a batch of texts at a time, in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes that end a word: space and 0x09 to 0x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z; all other bytes stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: The first n of eight little-endian bytes.
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], U)
_LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: every input bit moves every output bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def tidy(of):
    """A mapInArrow function that gives freed memory back to the system when its task ends: workers live on, and what
    one stage needed would stay beside what the next one needs."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes
        import gc

        try:
            yield from of(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return tidied


def text_chunks(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about that many bytes of text; a longer text is a slice of its own."""
    lengths = np.zeros(batch.num_rows, np.int64)
    if batch.num_rows:
        ends = _offsets(batch.column(column))
        lengths = np.diff(ends)
    begin, total = 0, 0
    for row, size in enumerate(lengths.tolist()):
        if row > begin and total + size > most_bytes:
            yield batch.slice(begin, row - begin)
            begin, total = row, 0
        total += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _offsets(array: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    buffers = array.buffers()
    return np.frombuffer(buffers[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins, with the end; a null counts as empty."""
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if array.null_count:
        array = array.fill_null("")
    at = _offsets(array)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of some texts: begin and end of each in data, and how many each text has."""

    def __init__(self, array: pa.Array, white: np.ndarray = WHITE):
        raw, at = text_bytes(array)
        self.data = FOLD[raw]
        inside = ~white[self.data]
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1] | edge[1:n]
            last[:-1] &= ~inside[1:] | edge[1:n]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.begin, at)  # the words of text i: bounds[i] to bounds[i+1]
        self.counts = np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return hashes(self.data, self.begin, self.end)


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    length = end - begin
    if not len(length):
        return np.zeros(0, U)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    lane = lambda at, left: np.ascontiguousarray(eight[at]).view("<u8").ravel() & _MASK[np.minimum(left, 8)]
    out = mix(lane(begin, length) + U(0x9E3779B97F4A7C15) * (length.astype(U) + U(1)))
    long = np.flatnonzero(length > 8)
    far = long[length[long] > _LONG]
    long, k = long[length[long] <= _LONG], 8
    while len(long):
        out[long] = mix(out[long] * U(0xD6E8FEB86659FD93) + lane(begin[long] + k, length[long] - k))
        k += 8
        long = long[length[long] > k]
    for i in far.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingles(words: Words, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of that many words; with fewer words, of the whole sequence."""
    each, out = words.hashes(), []
    n = len(each)
    rolled = np.zeros(max(0, n - size + 1), U)
    for k in range(size):
        rolled = rolled * U(0x9FB21C651E98DF25) + each[k : k + len(rolled)]
    rolled = mix(rolled)
    bounds = words.bounds.tolist()
    for b, e in zip(bounds, bounds[1:], strict=False):
        if e - b >= size:
            out.append(np.unique(rolled[b : e - size + 1]))
        elif e > b:
            whole = U(e - b)
            with np.errstate(over="ignore"):
                for h in each[b:e]:
                    whole = whole * U(0x9FB21C651E98DF25) + h
            out.append(mix(np.array([whole ^ U(0x5851F42D4C957F2D)], U)))
        else:
            out.append(np.zeros(0, U))
    return out
