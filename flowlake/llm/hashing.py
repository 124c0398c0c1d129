"""Vectorised 64-bit hashes of words and word n-grams over the bytes of many texts at once (numpy, inside tasks)."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Masks of the first 0 to 8 bytes of a block.
_FIRST = np.array([256**k - 1 for k in range(9)], dtype=np.uint64)
#: Longer ranges (words without any white space for so many bytes) are hashed one by one.
LONG = 64

#: Byte classes: 0 white space (0x20, 0x09-0x0D), 1 letters, digits and all of other alphabets, 2 other marks.
CLASSES = np.full(256, 2, dtype=np.uint8)
CLASSES[[0x20, *range(0x09, 0x0E)]] = 0
CLASSES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def runs(classes: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of one non-zero class; a document's start always begins a run."""
    n = len(classes)
    if n == 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    np.not_equal(classes[1:], classes[:-1], out=edge[1:n])
    edge[doc_starts[doc_starts < n]] = True
    cuts = np.flatnonzero(edge)
    keep = classes[cuts[:-1]] != 0
    return cuts[:-1][keep], cuts[1:][keep]


def blocks_of(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each byte of ``data`` on, as little-endian integers; zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def block(blocks: np.ndarray, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes at each start, of which only the first ``left`` (1 or more) count."""
    return blocks[starts] & _FIRST[np.minimum(left, 8)]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each range, the same wherever the range stands. Every block of eight bytes is mixed into the
    hash of those before it, so no pattern of bytes cancels out; ranges beyond LONG bytes take a cryptographic hash."""
    sizes = ends - starts
    h = mix(sizes.astype(np.uint64) * _ODD + _MIX2)
    if len(sizes) == 0:
        return h
    blocks = blocks_of(data)
    rows = np.flatnonzero((sizes > 0) & (sizes <= LONG))
    at, left = starts[rows], sizes[rows]
    while len(rows):
        h[rows] = mix(mix(h[rows] ^ block(blocks, at, left)) + _ODD)
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


@dataclass
class Words:
    """Hashes of the words of some documents; document i owns hashes[bounds[i]:bounds[i + 1]]."""

    hashes: np.ndarray
    bounds: np.ndarray

    def ngrams(self, n: int) -> "Words":
        """Hashes of all n-word windows; a document of 1 to n - 1 words has its whole sequence as one."""
        h, counts = self.hashes, np.diff(self.bounds)
        sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(int(bounds[-1])) + np.repeat(self.bounds[:-1] - bounds[:-1], sizes)
        left = np.repeat(np.minimum(counts, n), sizes)
        out = np.zeros(len(at), dtype=np.uint64)
        for j in range(n):
            inside = left > j
            out += np.where(inside, mix(h[np.where(inside, at + j, 0)] + np.uint64((j + 1) * int(_ODD) % 2**64)), np.uint64(0)) if len(h) else 0
        return Words(mix(out + left.astype(np.uint64)), bounds)

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]


def chunks(texts: list[bytes], most: int = 500_000):
    """(first, last) of consecutive documents with about ``most`` bytes; a longer document stands alone."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield first, i
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield first, len(texts)


def words_of(texts: list[bytes], split_marks: bool = False, lower: bool = True) -> Words:
    """Words of UTF-8 texts: longest runs without white space; with ``split_marks`` also cut between letters and marks."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    doc_starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    classes = CLASSES[data]
    starts, stops = runs(classes if split_marks else np.minimum(classes, 1), doc_starts)
    bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
    return Words(range_hashes(LOWER[data] if lower else data, starts, stops), bounds)
