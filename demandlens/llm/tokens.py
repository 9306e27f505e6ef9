"""Token ids of whole texts with a public tokenizer, a record batch at a time.

The tokenizer drops white space and splits there, so the ids of a text are those of its
white-space chunks one after the other. Arrow splits a batch into chunks and finds the
distinct ones; only those are looked up or encoded, and numpy lays their ids out in text
order. Prose chunks (Latin letters, then plain punctuation) are encoded as their lower-cased
letters and their punctuation, which a worker remembers up to a bound.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Words a worker remembers; beyond it the memo starts anew.
MEMO = 500_000
#: Texts are laid out in groups of about so many bytes.
GROUP_BYTES = 1 << 24
_PROSE = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_MARKS = ".,;:!?"
_SEPARATOR = "<|endoftext|>"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each span in turn."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


class WordEncoder:
    """Ids as unsigned 16-bit integers (the vocabulary has 49,408 ids)."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.separator = self.tokenizer.token_to_id(_SEPARATOR)
        self.word_end = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.words: dict[str, bytes] = {"": b""}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) in a row, and where each text's begin (one more at the end)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // GROUP_BYTES
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)]]).tolist()
        found = [self._group(texts.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
        if not found:
            return np.zeros(0, np.uint16), np.zeros(1, np.int64)
        counts = np.concatenate([c for _, c in found])
        return np.concatenate([i for i, _ in found]), np.concatenate([[0], np.cumsum(counts)])

    def _group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        chunks = split.flatten().dictionary_encode()
        flat, begin, length = self._distinct(chunks.dictionary)
        at = chunks.indices.to_numpy(zero_copy_only=False)
        size = length[at]
        ids = flat[spans(begin[at], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        offsets = split.offsets.to_numpy(zero_copy_only=False)
        offsets = offsets - offsets[0]
        return ids, np.diff(ends[offsets])

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of each chunk: all ids in a row, first place and count of each chunk's."""
        letters = pc.utf8_rtrim(chunks, characters=_MARKS)
        prose = pc.match_substring_regex(letters, _PROSE)
        marks_len = pc.subtract(pc.binary_length(chunks), pc.binary_length(letters)).to_numpy(zero_copy_only=False)
        is_prose = prose.to_numpy(zero_copy_only=False)
        both = np.zeros((len(chunks), 2), dtype=np.int64)       # units of each chunk: letters, marks
        words = pc.utf8_lower(letters.filter(prose)).dictionary_encode()
        units = words.dictionary.to_pylist()
        both[is_prose, 0] = words.indices.to_numpy(zero_copy_only=False)
        others = chunks.filter(pc.invert(prose)).to_pylist()
        both[~is_prose, 0] = len(units) + np.arange(len(others))
        empty = len(units) + len(others)
        both[:, 1] = empty
        marked = np.flatnonzero(is_prose & (marks_len > 0))
        marks: dict[str, int] = {}
        for i, (s, n) in enumerate(zip(chunks.take(pa.array(marked)).to_pylist(), marks_len[marked].tolist())):
            both[marked[i], 1] = empty + 1 + marks.setdefault(s[-n:], len(marks))
        found = self._words(units) + self._others(others) + [b""] + self._words(list(marks))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 2
        flat = np.frombuffer(b"".join(found), dtype="<u2")
        begin = np.cumsum(size) - size
        order = both.ravel()
        length = size[both].sum(axis=1)
        return flat[spans(begin[order], size[order])], np.cumsum(length) - length, length

    def _ids(self, texts: list[str]) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return np.array([i for f in found for i in f.ids], dtype="<u2")

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of plain words (letters only or marks only), remembered."""
        known = list(map(self.words.get, words))
        missing = [i for i, k in enumerate(known) if k is None]
        if missing:
            new = [words[i] for i in missing]
            ids = self._ids([" ".join(new[i:i + 64]) for i in range(0, len(new), 64)])
            ends = (np.flatnonzero(self.word_end[ids]) + 1).tolist()
            if len(ends) != len(new):
                raise AssertionError("word ends and words differ")
            data, begin = ids.tobytes(), 0
            if len(self.words) + len(new) > MEMO:
                self.words = {"": b""}
            for i, end in zip(missing, ends):
                known[i], begin = data[2 * begin:2 * end], end
                self.words[words[i]] = known[i]
        return known

    def _others(self, chunks: list[str]) -> list[bytes]:
        """Ids of any chunks; a special token's string within a chunk is that token, as in the tokenizer."""
        out = [self._ids([c]).tobytes() if "<|" in c else b"" for c in chunks]
        plain = [i for i, c in enumerate(chunks) if c and "<|" not in c]
        ids = self._ids([_SEPARATOR.join(chunks[i] for i in plain[k:k + 64]) + _SEPARATOR
                         for k in range(0, len(plain), 64)])
        cuts = np.flatnonzero(ids == self.separator).tolist()
        if len(cuts) != len(plain):
            raise AssertionError("separators and chunks differ")
        data, begin = ids.tobytes(), 0
        for i, end in zip(plain, cuts):
            out[i], begin = data[2 * begin:2 * end], end + 1
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder a worker process and tokenizer file."""
    return WordEncoder(path)


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
