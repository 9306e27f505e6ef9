"""Words of whole texts and hashes of word windows, vectorised over groups of texts.

A word is a run of bytes other than space and \\x09-\\x0D. Its 64-bit hash is a polynomial of
its bytes modulo 2^64 with random per-byte numbers, passed through a strong finaliser; a
window's hash is a polynomial of its words' hashes. Equal words and windows hash equally
everywhere; different ones collide with a chance of about 2^-60 a pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GROUP_BYTES = 1 << 20
_RNG = np.random.default_rng(20240917)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_R, _M = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


_POWERS: dict[int, np.ndarray] = {}         # the longest run of each base so far


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(1 << max(10, int(n - 1).bit_length()), base, np.uint64)
        known[0] = 1
        np.cumprod(known, out=known)
        _POWERS[base] = known
    return known[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser (xor-shift and multiply) of 64-bit numbers."""
    x = x ^ np.uint64((salt * 0x9FB21C651E98DF25 + salt) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    text: bytes             # the texts of the group, a line feed after each
    start: np.ndarray       # of every word, in ``text``
    end: np.ndarray
    doc: np.ndarray         # index of the word's text in the group
    first: np.ndarray       # index of each text's first word; one more at the end
    hash: np.ndarray

    def windows(self, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``n`` words within a text, and the windows' hashes."""
        if len(self.hash) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:len(self.doc) - n + 1] == self.doc[n - 1:])
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.hash, salt) * powers(_M, len(self.hash)))])
        return at, mix((total[at + n] - total[at]) * powers(inverse(_M), len(self.hash))[at])


def words(texts: list[bytes], lower: bool = False) -> Words:
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined.translate(LOWER) if lower else joined, np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    total = np.cumsum(_BYTE[data] * powers(_R, len(data)))
    before = np.where(start > 0, total[start - 1], np.uint64(0))
    h = mix((total[end - 1] - before) * powers(inverse(_R), len(data))[start] + (end - start).astype(np.uint64))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.cumsum(sizes) - sizes
    first = np.searchsorted(start, np.append(begins, len(data)))
    return Words(joined, start, end, np.repeat(np.arange(len(texts)), np.diff(first)), first, h)


def groups(texts: list[bytes], size: int = GROUP_BYTES):
    """(offset, texts) runs of about ``size`` bytes; a longer text is a run of its own."""
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= size or i + 1 == len(texts):
            yield at, texts[at:i + 1]
            at, held = i + 1, 0
