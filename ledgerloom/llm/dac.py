"""Directly addressable codes: token ids in chunk levels, any of which is read without decoding others.

A file, all little-endian:
  magic 'LOOMDAC1'; uint64 tokens; uint64 documents; uint64 levels; for each level uint64 bits, uint64 items
  int64 id of each document (and a byte for each: 1 if it is null); uint64 first token of each document, and the end
  for each level: a byte for each item; the continuation bitmap in uint64 words; uint64 rank before every 512 bits
Every section begins at a multiple of 8. Level 0 has the lowest bits of every id; a set bit in its bitmap says that the
id goes on in the next level, at the place that the number of set bits before it gives.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"LOOMDAC1"
#: Bits of each level; together 32.
WIDTHS = (8, 8, 8, 8)
SUPER = 512


def _packed(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmap words, padded to whole superblocks and one word more, and the ranks before each superblock."""
    words = np.zeros((len(flags) // SUPER + 1) * (SUPER // 64), "<u8")
    bits = np.packbits(flags, bitorder="little")
    words.view(np.uint8)[: len(bits)] = bits
    per = np.bitwise_count(words).reshape(-1, SUPER // 64).sum(1).astype("<u8")
    return words, np.concatenate([[0], np.cumsum(per)[:-1]]).astype("<u8")


def _pad(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


def encode(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """A file of the documents' ids: starts has the first of each in ids, and the end."""
    rest, levels = ids.astype(np.uint32), []
    for bits in widths:
        chunk = (rest & np.uint32((1 << bits) - 1)).astype(np.uint8)
        rest = rest >> np.uint32(bits) if bits < 32 else np.zeros_like(rest)
        more = rest > 0
        levels.append((bits, chunk, more))
        rest = rest[more]
        if not len(rest):
            break
    if len(rest):
        raise ValueError("an id is too large for the levels")
    head = MAGIC + struct.pack("<3Q", len(ids), len(doc_ids), len(levels)) + b"".join(struct.pack("<2Q", bits, len(c)) for bits, c, _ in levels)
    body = [head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), _pad(bytes(d is None for d in doc_ids)), starts.astype("<u8").tobytes()]
    for _, chunk, more in levels:
        words, ranks = _packed(more)
        body += [_pad(chunk.tobytes()), words.tobytes(), ranks.tobytes()]
    return b"".join(body)


class Ranged:
    """An open file, of which slices are read where they are asked for; `taken` counts their bytes."""

    def __init__(self, file):
        self.file, self.taken = file, 0

    def __getitem__(self, where: slice) -> bytes:
        self.taken += where.stop - where.start
        return self.file.read_at(where.stop - where.start, where.start)


class _Section:
    """An array in a Ranged file: a place or a slice of it is read when it is asked for."""

    def __init__(self, data: Ranged, kind: str, n: int, at: int):
        self.data, self.kind, self.n, self.at, self.size = data, kind, n, at, np.dtype(kind).itemsize

    def __getitem__(self, k):
        begin, end = (k.start, min(k.stop, self.n)) if isinstance(k, slice) else (k, k + 1)
        out = np.frombuffer(self.data[self.at + begin * self.size : self.at + max(begin, end) * self.size], self.kind)
        return out if isinstance(k, slice) else out[0]


class DacFile:
    """A file's bytes (or a memory map, or a Ranged file): tokens by place, and documents."""

    def __init__(self, data):
        if bytes(data[0:8]) != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.tokens, self.documents, levels = struct.unpack("<3Q", data[8:32])
        at = 32
        shapes = [struct.unpack("<2Q", data[at + 16 * k : at + 16 * k + 16]) for k in range(levels)]
        at += 16 * levels

        def take(kind: str, n: int):
            nonlocal at
            out = _Section(data, kind, n, at) if isinstance(data, Ranged) else np.frombuffer(data, kind, n, at)
            size = n * np.dtype(kind).itemsize
            at += size + (-size % 8)
            return out

        ids, null = take("<i8", self.documents), take("u1", self.documents)
        self._ids = ids, null
        self.starts = take("<u8", self.documents + 1)
        self.levels = []
        for bits, n in shapes:
            supers = n // SUPER + 1
            self.levels.append((bits, take("u1", n), take("<u8", supers * (SUPER // 64)), take("<u8", supers)))

    @property
    def doc_ids(self) -> list[int | None]:
        ids, null = (x[0 : self.documents] for x in self._ids)
        return [None if x else d for d, x in zip(ids.tolist(), null.tolist(), strict=True)]

    @staticmethod
    def _rank(words: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before bit i."""
        word = i // 64
        begin = word - word % (SUPER // 64)
        inside = int(np.bitwise_count(words[begin:word]).sum()) if word > begin else 0
        return int(ranks[i // SUPER]) + inside + (int(words[word]) & ((1 << (i % 64)) - 1)).bit_count()

    def token(self, i: int) -> int:
        """Token i of the file: one byte, and one rank, for each level that it has."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = shift = 0
        for bits, chunk, words, ranks in self.levels:
            value |= int(chunk[i]) << shift
            shift += bits
            if not int(words[i // 64]) >> (i % 64) & 1:
                return value
            i = self._rank(words, ranks, i)
        raise ValueError("the last level goes on")

    def slice(self, begin: int, end: int) -> np.ndarray:
        """Tokens begin to end; in each level they are neighbours."""
        out = np.zeros(end - begin, np.uint32)
        where, shift = np.arange(end - begin), 0
        for bits, chunk, words, ranks in self.levels:
            if begin == end:
                break
            out[where] |= chunk[begin:end].astype(np.uint32) << np.uint32(shift)
            shift += bits
            first = begin // 64
            flags = np.unpackbits(words[first : (end + 63) // 64].view(np.uint8), bitorder="little")[begin - 64 * first : end - 64 * first].astype(bool)
            where = where[flags]
            begin, end = self._rank(words, ranks, begin), self._rank(words, ranks, end)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))
