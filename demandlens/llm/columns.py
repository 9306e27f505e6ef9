"""Column-wise construction of a collection's Burrows-Wheeler transform and common prefixes.

Strings are parsed into phrases that end after white space; a phrase is a symbol, ranked by its
bytes, so symbol order is byte order. Each round inserts one symbol of every string, from the
last to the first: the new suffix's place follows from its successor's by the last-to-first
mapping, which needs only the transform so far and ranks only rows of the new symbols. The state -
preceding symbol, suffix, common prefix in bytes with the row above - lives in a flat file that
every round reads and rewrites from start to end; common prefixes are updated where rows were
inserted. A collection is a bucket of bounded size, so its rows fit a task's memory too.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .wordhash import inverse, mix, powers

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_R, _M = 0xA24BAED4963EE407 | 1, 0x9FB21C651E98DF25 | 1
_BYTE = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)


class Collection:
    def __init__(self, strings: list[bytes], cap: int):
        self.cap, self.m = cap, len(strings)
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        sizes = np.fromiter(map(len, strings), np.int64, self.m)
        self.end_byte = np.cumsum(sizes)
        self.begin_byte = self.end_byte - sizes
        last = _BLANK[self.data].copy()
        last[self.end_byte - 1] = True
        ends = np.flatnonzero(last) + 1
        self.byte = np.concatenate([[0], ends])                       # first byte of each symbol
        self.first = np.searchsorted(self.byte, self.begin_byte)      # first symbol of each string
        self.last = np.searchsorted(self.byte, self.end_byte)         # one past its last symbol
        phrases = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(self.byte.astype(np.int32)),
                                                                 pa.py_buffer(self.data)]).dictionary_encode()
        order = pc.sort_indices(phrases.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.none = len(order)                                        # before a string's first symbol
        kind = np.uint16 if self.none < 65535 else np.int32           # sixteen bits sort by radix
        self.symbol = rank[phrases.indices.to_numpy()].astype(kind)
        self.string = np.repeat(np.arange(self.m), self.last - self.first)
        n = len(self.symbol)
        self.total = np.concatenate([np.zeros(1, np.uint64),
                                     np.cumsum(mix(self.symbol.astype(np.uint64) + np.uint64(1)) * powers(_M, n))])
        self.undo = powers(inverse(_M), n + 1)

    def before(self, suffix: np.ndarray, string: np.ndarray) -> np.ndarray:
        """The symbol before a suffix."""
        inside = suffix > self.first[string]
        return np.where(inside, self.symbol[np.maximum(suffix - 1, 0)], self.none).astype(self.symbol.dtype)

    def common(self, x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
        """Common prefix in bytes (at most ``cap``) of two suffixes of strings sx and sy."""
        low = np.zeros(len(x), np.int64)
        most = np.minimum(np.minimum(self.last[sx] - x, self.last[sy] - y), self.cap)
        hash_x, undo_x, hash_y, undo_y = self.total[x], self.undo[x], self.total[y], self.undo[y]
        for k in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
            to = low + (1 << k)
            fits = to <= most
            to = np.minimum(to, most)
            same = (self.total[x + to] - hash_x) * undo_x == (self.total[y + to] - hash_y) * undo_y
            low += (same & fits).astype(np.int64) << k
        n = self.byte[x + low] - self.byte[x]
        u, v = self.byte[x] + n, self.byte[y] + n
        room = np.minimum(np.minimum(self.end_byte[sx] - u, self.end_byte[sy] - v), self.cap - n)
        go, k = np.flatnonzero(room > 0), 0
        while len(go):
            go = go[self.data[u[go] + k] == self.data[v[go] + k]]
            n[go] += 1
            k += 1
            go = go[room[go] > k]
        return np.minimum(n, self.cap)

    def build(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes (symbol numbers) in order with their strings and common prefixes."""
        m, kind = self.m, self.symbol.dtype
        row = np.dtype([("before", kind), ("prefix", np.int16), ("suffix", np.int32)] + [("", np.int16)] * (3 * (kind.itemsize // 4)))
        words = (-1, row.itemsize // 8) if row.itemsize > 8 else -1   # rows move as whole words
        # the empty suffixes, in string order, are the first m rows; their strings are their numbers
        rows = np.zeros(m, row)
        rows["before"], rows["suffix"] = self.before(self.last, np.arange(m)), self.last
        with tempfile.TemporaryFile(prefix="columns-") as file:
            file.write(rows)
            newest, of, n = np.flatnonzero(self.first < self.last), np.flatnonzero(self.first < self.last), m
            total = np.bincount(rows["before"], minlength=self.none + 1)
            while len(newest):
                file.seek(0)
                rows = np.fromfile(file, row, n)
                before = np.ascontiguousarray(rows["before"])
                place, symbol = self._mapped(before, newest, total), before[newest]
                by = np.argsort(place)
                place, symbol, suffix, of = place[by], symbol[by], rows["suffix"][newest[by]] - 1, of[by]
                old = np.ones(n + len(place), bool)
                old[place] = False
                merged = np.empty(len(old), row)
                merged.view(np.uint64).reshape(words)[old] = rows.view(np.uint64).reshape(words)
                new = np.zeros(len(place), row)
                new["before"], new["suffix"] = self.before(suffix, of), suffix
                total += np.bincount(new["before"], minlength=self.none + 1)
                merged[place] = new
                # the pairs of neighbours that a new row is one of
                touched = np.concatenate([place, place[np.append(place[1:] != place[:-1] + 1, True)] + 1])
                touched = touched[(touched > m) & (touched < len(old))]
                x, y = merged["suffix"][touched - 1].astype(np.int64), merged["suffix"][touched].astype(np.int64)
                merged["prefix"][touched] = self.common(x, y, self.string[x], self.string[y])
                file.seek(0)
                file.write(merged)
                n = len(old)
                more = new["before"] != self.none
                newest, of = place[more], of[more]
            file.seek(0)
            rows = np.fromfile(file, row, n)
        suffix = rows["suffix"].astype(np.int64)
        string = np.concatenate([np.arange(m), self.string[suffix[m:]]])
        return suffix, string, rows["prefix"].astype(np.int64)

    def _mapped(self, before: np.ndarray, newest: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Last-to-first mapping of the newest rows: rows of smaller symbols, then those of the same
        symbol above. Only rows of the newest symbols are ranked. ``total``: rows of each symbol."""
        symbol = before[newest]
        smaller = np.cumsum(total) - total
        wanted = np.zeros(self.none + 1, bool)
        wanted[symbol] = True
        own = np.flatnonzero(wanted)
        ranked = np.flatnonzero(wanted[before])
        order = np.argsort(before[ranked], kind="stable")
        place = np.empty(len(ranked), np.int64)
        place[order] = np.arange(len(ranked))
        smaller[own] -= np.cumsum(total[own]) - total[own]        # ranks run on over the newest symbols
        return self.m + smaller[symbol] + place[np.searchsorted(ranked, newest)]


def repeated(strings: list[bytes], times: np.ndarray, length: int) -> np.ndarray:
    """For each byte of the strings in a row: does a ``length``-byte string that occurs at least
    twice in them (string i counts ``times[i]``) start there?

    A window is named by its tail, the t bytes up to the end of the phrase it starts in, and by the
    first length - t bytes of the suffix after them: rows between which no common prefix is below
    length - t share those bytes. Windows without white space before their last byte are named by
    all their bytes, wherever their phrase ends."""
    c = Collection(strings, length)
    suffix, string, prefix = c.build()
    n = len(c.data)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[c.data] * powers(_R, n))])
    undo = powers(inverse(_R), n + 1)
    at = c.byte[suffix]
    phrase = np.where(suffix > c.first[string], at - c.byte[np.maximum(suffix - 1, 0)], 0)    # bytes of the one before
    rest = c.end_byte[string] - at
    found = np.zeros(n, bool)
    rows = np.argsort(-phrase, kind="stable")
    longest = -phrase[rows]

    def mark(names: np.ndarray, begin: np.ndarray, of: np.ndarray) -> None:
        _, back = np.unique(names, return_inverse=True)
        found[begin[np.bincount(back, times[of])[back] >= 2]] = True

    for t in range(1, min(int(phrase.max(initial=0)) + 1, length)):
        own = rows[:np.searchsorted(longest, -t, side="right")]            # phrases of at least t bytes
        own = own[rest[own] >= length - t]
        if len(own):
            run = np.cumsum(prefix < length - t)[own].astype(np.uint64)
            begin = at[own] - t
            tail = (total[at[own]] - total[begin]) * undo[begin]
            mark(mix(mix(run + np.uint64(1)) + tail), begin, string[own])
    own = rows[:np.searchsorted(longest, -length, side="right")]
    if len(own):
        many = phrase[own] - length + 1
        begin = np.repeat(at[own] - phrase[own], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        mark(mix((total[begin + length] - total[begin]) * undo[begin]), begin, np.repeat(string[own], many))
    return found
