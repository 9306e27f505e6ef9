"""Suffix-array dedup by column-wise multi-document construction (see ``columns``).

The construction runs over whole documents' repeats, cut so that each task holds a bounded
collection with short columns:

1. Every ``length``-byte string has an anchor, its ``ANCHOR``-byte piece with the smallest hash
   (leftmost). Equal strings have equal anchors at equal offsets. Runs of neighbouring strings
   with one anchor form a context. Blocks exchange anchors' counts; contexts whose anchor
   occurs once hold no repeat.
2. The other contexts go to buckets by anchor, distinct ones once with their count; there the
   column-wise construction finds which of their strings occur twice. An anchor of more than
   ``HOT`` occurrences is split: its strings go, by ranges of offsets, to buckets by the bytes all
   strings of the range share, so one passage with countless variants is not one bucket. What
   runs over a passage's edge shares those bytes too, whatever follows: blocks count the distinct
   pieces of each such route, and a route of more than ``HOT`` goes one string at a time, by the
   string's own hash, so that equal strings still meet.
3. Blocks remove the bytes that repeated strings cover.

Defined cases: null text is empty; shorter texts hold no string and are kept; null or repeated
doc_ids are separate documents (a repeated row repeats its text); empty tables give no rows;
only doc_id and text are read. Anchors and buckets go by 64-bit hashes; anchors only choose
what is compared, and a string's identity in a bucket is its run of rows and its tail.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import repeated
from .common import id_text, written
from .exchange import PACKED, Block, answers, ask, blocks
from .substring import _cut
from .wordhash import groups, inverse, mix, powers

LENGTH, ANCHOR, HOT, RANGE = 400, 64, 4096, 32
BUCKET_BYTES, KEYS = 1 << 20, 1 << 20
_R, _ORDER = 0xC2B2AE3D27D4EB4F | 1, 0xD6E8FEB86659FD93 | 1
_BYTE = np.random.default_rng(101).integers(1, 1 << 63, 256, dtype=np.uint64)


class Contexts:
    """Runs of strings with a common anchor in a group of texts."""

    def __init__(self, texts: list[bytes], length: int):
        self.data = b"".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        n, anchor = len(raw), min(ANCHOR, length)
        self.ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * powers(_R, max(n, 1))[:n], out=self.total[1:])
        self.undo = powers(inverse(_R), n + 1)
        self.begin = self.end = self.at = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.uint64)
        if n < length:
            return
        count = n - anchor + 1
        piece = (self.total[anchor:] - self.total[:count]) * self.undo[:count] * np.uint64(_ORDER)
        # 32 hash bits, then the place: the smallest is the leftmost of the smallest hashes
        piece &= np.uint64(0xFFFFFFFF00000000)
        piece |= np.arange(count, dtype=np.uint64)
        least = _least(piece, length - anchor + 1)
        where = least.astype(np.uint32)                           # the low half: anchor's place of each string
        begins = np.concatenate([[0], self.ends[:-1]])
        edges = np.concatenate([np.flatnonzero(where[1:] != where[:-1]) + 1, begins, np.maximum(self.ends - length + 1, 0)])
        edges = np.unique(edges[edges < len(where)])
        doc = np.searchsorted(self.ends, edges, side="right")
        inside = edges + length <= self.ends[np.minimum(doc, len(self.ends) - 1)]
        stop = np.append(edges[1:], len(where))
        self.begin, self.end = edges[inside], stop[inside]         # first string, one past the last
        self.at = where[self.begin].astype(np.int64)
        self.key = self.hash(self.at, anchor)

    def hash(self, at: np.ndarray, size) -> np.ndarray:
        return mix((self.total[at + size] - self.total[at]) * self.undo[at])

    def pieces(self, kept: np.ndarray, hot: np.ndarray, length: int, crowded: np.ndarray | None = None):
        """(first string, one past the last, route) of the kept contexts, hot ones in offset ranges,
        those of ``crowded`` routes string by string."""
        plain, wide = kept & ~hot, np.flatnonzero(kept & hot)
        out = [(self.begin[plain], self.end[plain], self.key[plain])]
        if len(wide):
            # strings starting at the anchor less an offset, offsets in ranges of RANGE
            n = self.end[wide] - self.begin[wide]
            of = np.repeat(np.arange(len(wide)), n)
            at = _runs(self.begin[wide], n)
            band = (self.at[wide][of] - at) // RANGE
            edge = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (band[1:] != band[:-1])))
            lo, hi = at[edge], at[np.append(edge[1:], len(at)) - 1] + 1
            core = self.at[wide][of[edge]] - band[edge] * RANGE        # start of the range's rightmost string
            size = length - RANGE + 1                                  # up to the end of its leftmost
            route = mix(self.hash(core, size) + band[edge].astype(np.uint64), 7)
            if crowded is not None and (many := np.isin(route, crowded)).any():
                own = _runs(lo[many], hi[many] - lo[many])
                out.append((own, own + 1, mix(self.hash(own, length), 8)))
                lo, hi, route = lo[~many], hi[~many], route[~many]
            out.append((lo, hi, route))
        begin, end, route = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(begin, kind="stable")
        return begin[order], end[order], route[order]


def _least(x: np.ndarray, width: int, step: int = 1 << 14) -> np.ndarray:
    """The smallest of each ``width`` neighbours, by runs that stay in the processor's cache."""
    out = np.empty(len(x) - width + 1, x.dtype)
    for k in range(0, len(out), step):
        least, span = x[k:k + step + width - 1], 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        out[k:k + step] = np.minimum(least[:-(width - span)], least[width - span:]) if width > span else least
    return out


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each run in turn."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


Groups = list[tuple[int, list[bytes], Contexts]]


def contexts(texts: list[bytes], length: int) -> Groups:
    """Offset, texts and contexts of a block's groups."""
    return [(offset, own, Contexts(own, length)) for offset, own in groups(texts)]


def anchors(found: Groups, buckets: int):
    """Distinct anchors of a block by bucket, and their counts."""
    key, n = np.unique(np.concatenate([c.key for _, _, c in found]), return_counts=True)
    bucket = (mix(key, 3) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return bucket[order], key[order], n[order]


def _add_counts(bucket: int, asked: list[tuple[bytes, bytes]], hot: int = HOT) -> list[tuple[bytes, bytes]]:
    keys = [np.frombuffer(a, np.uint64) for a, _ in asked]
    _, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, np.concatenate([np.frombuffer(b, np.int64) for _, b in asked]))[back]
    level = ((total > 1).astype(np.uint8) + (total > hot)).astype(np.uint8)     # 0 once, 1 repeated, 2 hot
    at = np.cumsum([0, *map(len, keys)])
    return [(level[a:b].tobytes(), b"") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def routes(found: Groups, length: int, levels: tuple[np.ndarray, np.ndarray], buckets: int):
    """Routes of a block's hot contexts by bucket, and how many distinct pieces each has."""
    known, level = levels
    held = [(np.zeros(0, np.uint64),) * 2]
    for _, _, c in found:
        if len(c.key):
            hot = level[np.searchsorted(known, c.key)] > 1
            begin, end, route = c.pieces(hot, hot, length)
            held.append((route, c.hash(begin, end - 1 + length - begin)))
    route, piece = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((piece, route))
    route, piece = route[order], piece[order]
    new = np.append(True, (route[1:] != route[:-1]) | (piece[1:] != piece[:-1]))[:len(route)]
    key, n = np.unique(route[new], return_counts=True)
    bucket = (mix(key, 3) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return bucket[order], key[order], n[order]


def _pieces(found: Groups, length: int, levels: tuple[np.ndarray, np.ndarray], crowded: np.ndarray | None = None):
    """Per group: offset, texts, contexts and the pieces to compare."""
    known, level = levels
    for offset, own, c in found:
        if len(c.key):
            l = level[np.searchsorted(known, c.key)]
            yield offset, own, c, c.pieces(l > 0, l > 1, length, crowded)
        else:
            yield offset, own, c, (c.begin, c.end, c.key)


def _find(bucket: int, asked: list[tuple[bytes, bytes]], length: int) -> list[tuple[bytes, bytes]]:
    """For each question's strings: which starts hold a repeated string, as bits in a row."""
    number: dict[bytes, int] = {}
    times, of = [], []
    for data, head in asked:
        sizes = np.frombuffer(head, np.int32).reshape(-1, 2)
        ends, own = np.cumsum(sizes[:, 0]).tolist(), []
        for e, (k, t) in zip(ends, sizes.tolist()):
            i = number.setdefault(data[e - k:e], len(number))
            if i == len(times):
                times.append(0)
            times[i] += t
            own.append(i)
        of.append(own)
    strings = list(number)
    found = repeated(strings, np.array(times, np.float64), length)
    ends = np.cumsum([0, *map(len, strings)])
    return [(np.packbits(np.concatenate([found[ends[i]:ends[i + 1] - length + 1] for i in own])).tobytes(), b"")
            for own in of]


def remove(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, kept (binary), n_bytes, n_removed, n_spans, kept_sha256."""
    parts = written(id_text(docs), "suffix-docs", compression="zstd")
    total = parts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    key_buckets = max(1, total // 128 // KEYS)
    buckets = max(1, total // BUCKET_BYTES)

    def count(block: Block):
        b, key, n = anchors(contexts(block.texts, length), key_buckets)
        return [(k, key[own].tobytes(), n[own].astype(np.int64).tobytes()) for k, own in _cut(b, 1)]

    counted = ask(parts, count, lambda b, asked: _add_counts(b, asked, hot), "suffix-anchors")

    def levels(block: Block, own: Groups) -> tuple[np.ndarray, np.ndarray]:
        b, key, _ = anchors(own, key_buckets)
        found, level = answers(counted, block), np.zeros(len(key), np.uint8)
        for k, at in _cut(b, 1):
            level[at] = np.frombuffer(found[k][0], np.uint8)
        order = np.argsort(key)
        return key[order], level[order]

    def count_routes(block: Block):
        if not any(b"\x02" in a for a, _ in answers(counted, block).values()):
            return []
        own = contexts(block.texts, length)
        b, key, n = routes(own, length, levels(block, own), key_buckets)
        return [(k, key[at].tobytes(), n[at].tobytes()) for k, at in _cut(b, 1)]

    asked_again = None
    if docs.sparkSession.read.schema(PACKED).parquet(counted).filter("contains(a, X'02')").limit(1).count():
        asked_again = ask(parts, count_routes, lambda b, asked: _add_counts(b, asked, hot), "suffix-routes")

    def crowded(block: Block, own: Groups, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray | None:
        if asked_again is None or not (found := answers(asked_again, block)):
            return None
        b, key, _ = routes(own, length, known, key_buckets)
        level = [np.frombuffer(found[k][0], np.uint8) for k, _ in _cut(b, 1)]
        return key[np.concatenate(level) > 1]

    def strings(block: Block):
        """The pieces' distinct strings by bucket, and per group each piece's bucket and number there."""
        by: dict[int, dict[bytes, list[int]]] = {}
        spots, whole = [], contexts(block.texts, length)
        known = levels(block, whole)
        for offset, own, c, (begin, end, route) in _pieces(whole, length, known, crowded(block, whole, known)):
            spot = []
            for s, e, b in zip(begin.tolist(), end.tolist(), (mix(route, 5) % np.uint64(buckets)).tolist()):
                held = by.setdefault(b, {})
                entry = held.setdefault(c.data[s:e - 1 + length], [len(held), 0])
                entry[1] += 1
                spot.append((s, e, b, entry[0]))
            spots.append((offset, own, c.ends, spot))
        return by, spots

    def question(block: Block):
        by, _ = strings(block)
        return [(b, b"".join(held), np.array([(len(x), n) for x, (_, n) in held.items()], np.int32).tobytes())
                for b, held in sorted(by.items())]

    compared = ask(parts, question, lambda b, asked: _find(b, asked, length), "suffix-repeats")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            by, spots = strings(block)
            found = answers(compared, block)
            bits, places = {}, {}
            for b, held in by.items():
                sizes = np.array([len(x) - length + 1 for x in held])
                bits[b] = np.unpackbits(np.frombuffer(found[b][0], np.uint8), count=int(sizes.sum()))
                places[b] = np.cumsum(sizes) - sizes
            for offset, own, ends, spot in spots:
                step = np.zeros(int(ends[-1]) + 1, np.int64)
                for s, e, b, i in spot:
                    starts = s + np.flatnonzero(bits[b][places[b][i]:places[b][i] + e - s])
                    step[starts] += 1
                    step[starts + length] -= 1
                gone = np.cumsum(step[:-1]) > 0
                yield _rows(block.ids[offset:offset + len(own)], own, ends, gone)

    return parts.mapInArrow(apply, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


_ROWS = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                   ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _rows(ids: list, texts: list[bytes], ends: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    rows = []
    for doc_id, text, end in zip(ids, texts, ends.tolist()):
        own = gone[end - len(text):end]
        removed = int(own.sum())
        spans = int(own[0]) + int(np.count_nonzero(own[1:] & ~own[:-1])) if removed else 0
        kept = np.frombuffer(text, np.uint8)[~own].tobytes() if removed else text
        rows.append((doc_id, kept, len(text), removed, spans, hashlib.sha256(kept).hexdigest()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ROWS.types)], schema=_ROWS)
