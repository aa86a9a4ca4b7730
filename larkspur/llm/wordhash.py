"""Vectorised word hashing for a batch of texts.

A batch's UTF-8 bytes lie in one array. A prefix sum of byte * P**position (mod 2**64) gives the hash of any
span from two lookups, whatever the words' lengths, so no Python code runs for each word.
"""

from __future__ import annotations

import numpy as np

P = np.uint64(0x9E3779B97F4A7C15 | 1)
P_INV = np.uint64(pow(int(P), -1, 1 << 64))
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as doubles in (0, 1), never 0."""
    return ((x >> _U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


_POWERS = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**0..P**(n-1) and their inverses; kept and grown as needed."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        both = []
        for base in (P, P_INV):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        _POWERS = tuple(both)
    return _POWERS[0][:n], _POWERS[1][:n]


class SpanHasher:
    """Hashes of [start, end) spans of one byte array."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + _U(1)) * up[:-1], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


# Letters, digits and every byte of a multi-byte character belong to a word.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words of the texts in order, and the offsets at which each text's words begin (one more than texts)."""
    parts = [t.lower().encode("utf-8") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    inside = WORD_BYTE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    hashes = mix(SpanHasher(data).raw(start, end))
    ends = np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, dtype=np.int64)
    return hashes, np.concatenate(([0], np.searchsorted(start, ends)))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of `width` words; a shorter text is one run of all it has; no words, no runs."""
    n = len(words)
    if n == 0:
        return words
    width = min(width, n)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for j in range(width):
        out = out * P + words[j : n - width + 1 + j]
    return mix(out)
