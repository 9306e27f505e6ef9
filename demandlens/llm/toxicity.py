"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the average of the vectors of its character n-grams (hashed) and of itself, so an
unseen misspelling or inflection shares most of its vectors with words seen in training. The
words of a short segment are averaged and a linear softmax over two classes gives its
log-odds; a text is as toxic as its most toxic segment, so a few words count in a long text
too. Vectors and softmax are trained jointly in numpy (Adam; first on whole-text averages,
then on each text's most toxic segment), on the driver, from a bounded sample of labelled
rows (whole texts of any length in hash order: at most ``sample_rows`` a class, and none after
``sample_rows * sample_bytes`` bytes of the class). Scoring covers all rows.

Defined cases: a null, empty or wordless text scores as the median text of label 0; a null doc_id is held
out and scored; repeated rows are scored each; of contradicting labels the larger holds; null
labels teach nothing; without labels of both classes every score is the share of label 1 (0
without labels); only doc_id and text are read from documents, doc_id and toxic from labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, text_slices, tidy
from .wordhash import inverse, mix, powers

BUCKETS, DIM, SEGMENT = 1 << 18, 8, 8
NGRAMS = (3, 4, 5)
#: words hashed at once
RUN = 1 << 14
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»…“”‘’"
_BASE = 0x9E3779B97F4A7C15 | 1


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (lower case, without marks at their ends), each word's number in text
    order, and where each text's words begin (one more at the end)."""
    split = pc.ascii_split_whitespace(pc.utf8_trim(pc.fill_null(texts.cast(pa.large_string()), ""), characters=" \t\n\r\x0b\x0c"))
    offsets = split.offsets.to_numpy(zero_copy_only=False)
    flat = split.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)       # an empty text splits into one empty word
    places = np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]]
    chunks = flat.filter(pa.array(real)).dictionary_encode()
    words = pc.utf8_trim(pc.utf8_lower(chunks.dictionary), characters=_MARKS).dictionary_encode()
    number = words.indices.to_numpy(zero_copy_only=False)[chunks.indices.to_numpy(zero_copy_only=False)]
    return words.dictionary, number, places


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of each word, with brackets at its ends, and of the
    whole word; and the number of the word each belongs to."""
    data = np.frombuffer(("<" + "><".join(words.to_pylist()) + ">").encode("utf-32-le"), np.uint32)
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    point = mix(data.astype(np.uint64), 31)
    buckets, owner, at = [], [], np.arange(len(data))
    for n in NGRAMS:
        if len(data) < n:
            continue
        h = np.zeros(len(data) - n + 1, np.uint64)
        for k in range(n):
            h = h * np.uint64(_BASE) + point[k:k + len(h)]
        inside = at[:len(h)] + n <= ends[of[:len(h)]]
        buckets.append((mix(h[inside], n) % np.uint64(BUCKETS)).astype(np.int32))
        owner.append(of[:len(h)][inside])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(point * powers(_BASE, len(data)))])
    begins = ends - sizes
    whole = (total[ends] - total[begins]) * powers(inverse(_BASE), len(data) + 1)[begins]
    buckets.append((mix(whole, 1) % np.uint64(BUCKETS)).astype(np.int32))
    owner.append(np.arange(len(sizes), dtype=np.int32))
    return np.concatenate(buckets), np.concatenate(owner)


def all_subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``subwords`` of any number of words, hashed a run of words at a time."""
    parts = [(np.zeros(0, np.int32),) * 2]
    for k in range(0, len(words), RUN):
        bucket, of = subwords(words.slice(k, RUN))
        parts.append((bucket, of + np.int32(k)))
    buckets, owner = zip(*parts)
    return np.concatenate(buckets), np.concatenate(owner)


@dataclass
class Model:
    """The trained parts folded into one number a bucket: log-odds are linear in the vectors."""
    weight: np.ndarray          # float32[BUCKETS]: vector . (softmax row 1 - row 0)
    bias: float
    empty: float                # log-odds of a text without words: the median of label 0's
    slope: float                # calibration of the most toxic segment's log-odds
    offset: float
    constant: float | None = None

    def probability(self, log_odds: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(log_odds), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * log_odds + self.offset, -30, 30)))


    def log_odds(self, texts: pa.Array) -> np.ndarray:
        """Of each whole text: its most toxic segment's."""
        words, number, places = split_words(texts)
        weights = [np.zeros(0)]
        for k in range(0, len(words), RUN):
            own = words.slice(k, RUN)
            bucket, of = subwords(own)
            count = np.bincount(of, minlength=len(own))
            weights.append(np.bincount(of, self.weight[bucket], minlength=len(own)) / count)
        value = np.concatenate(weights)[number]
        out = np.full(len(texts), self.empty)
        sizes = np.diff(places)
        full = np.flatnonzero(sizes)
        if len(full):
            at, first, length, _ = segments(places[:-1][full], sizes[full])
            out[full] = np.maximum.reduceat(np.add.reduceat(value, at) / length, first) + self.bias
        return out


def segments(begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of texts that lie in a row: first word, first segment of each text, words, text."""
    n = -(-sizes // SEGMENT)
    of = np.repeat(np.arange(len(sizes)), n)
    first = np.cumsum(n) - n
    at = begin[of] + (np.arange(len(of)) - first[of]) * SEGMENT
    return at, first, np.minimum(SEGMENT, begin[of] + sizes[of] - at), of


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each range in turn."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())


def train(texts: list[bytes] | pa.Array, labels: np.ndarray, class_share: float, seed: int = 7,
          warm: int = 25, rounds: int = 120, rate: float = 0.05, min_uses: int = 12,
          decay: float = 5e-4) -> Model:
    """Joint training on whole texts; ``class_share`` is label 1's share before sampling by class."""
    y = labels.astype(np.float64)
    constant = Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, 1.0, 0.0, float(class_share))
    if isinstance(texts, list):
        texts = pa.array(texts, pa.binary()).cast(pa.string())
    words, flat, places = split_words(texts)
    del texts
    kept = np.flatnonzero(np.diff(places))               # texts with words; the others take no places
    sizes, y = np.diff(places)[kept], y[kept]
    if not len(y) or y.min() == y.max():
        return constant
    gram, word_of = all_subwords(words)
    g_len = np.bincount(word_of, minlength=len(words))
    uses = np.bincount(gram, np.bincount(flat, minlength=len(words))[word_of], minlength=BUCKETS)
    known = np.flatnonzero(uses >= min_uses)             # rarer buckets keep a zero vector
    slot = np.zeros(BUCKETS, np.int32)
    slot[known] = np.arange(1, len(known) + 1)
    gram = slot[gram]
    word_of, gram = word_of[gram > 0], gram[gram > 0]
    order = np.argsort(np.concatenate([word_of, np.arange(len(words), dtype=np.int32)]), kind="stable")
    gram = np.concatenate([gram, np.zeros(len(words), np.int32)])[order]         # one zero a word
    g_kept = np.bincount(word_of, minlength=len(words)) + 1
    g_at = np.cumsum(g_kept) - g_kept
    del order, word_of, uses, slot
    doc_at = np.cumsum(sizes) - sizes
    seg_at, seg_first, seg_len, seg_doc = segments(doc_at, sizes)

    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.05, (len(known) + 1, DIM))
    e[0] = 0
    w, b = rng.normal(0, 0.5, DIM), 0.0
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    moments = [np.zeros_like(e), np.zeros_like(e), np.zeros(DIM), np.zeros(DIM), np.zeros(()), np.zeros(())]

    def adam(t: int, k: int, grad):
        """The step of one parameter; works in the memory of its moments and of ``grad``."""
        grad = np.asarray(grad, float)
        moments[k] *= 0.9
        moments[k] += 0.1 * grad
        grad *= grad
        grad *= 0.01
        moments[k + 1] *= 0.99
        moments[k + 1] += grad
        np.divide(moments[k + 1], 1 - 0.99 ** t, out=grad)
        np.sqrt(grad, out=grad)
        grad += 1e-8
        return np.divide(moments[k] * (rate / (1 - 0.9 ** t)), grad, out=grad)

    def forward() -> tuple[np.ndarray, np.ndarray]:
        value, word = e @ w, np.empty(len(g_len))
        for k in range(0, len(word), RUN):
            a, z = g_at[k], g_at[k + RUN] if k + RUN < len(word) else len(gram)
            word[k:k + RUN] = np.add.reduceat(value[gram[a:z]], g_at[k:k + RUN] - a)
        word /= g_len
        return word, np.add.reduceat(word[flat], seg_at) / seg_len

    for t in range(1, warm + rounds + 1):
        word, seg = forward()
        if t <= warm:
            z = np.add.reduceat(word[flat], doc_at) / sizes + b
            delta = (1 / (1 + np.exp(-z)) - y) * balance / len(y)
            g_word = np.bincount(flat, np.repeat(delta / sizes, sizes), minlength=len(g_len))
        else:
            top = np.maximum.reduceat(seg, seg_first)
            first = np.full(len(y), len(seg))
            np.minimum.at(first, seg_doc, np.where(seg == top[seg_doc], np.arange(len(seg)), len(seg)))
            z = top + b
            delta = (1 / (1 + np.exp(-z)) - y) * balance / len(y)
            length = seg_len[first]
            at = ranges(seg_at[first], length)
            g_word = np.bincount(flat[at], np.repeat(delta / length, length), minlength=len(g_len))
        used = np.flatnonzero(g_word)
        g_s = np.zeros(len(e))
        for k in range(0, len(used), RUN):               # the n-grams of a run of words at a time
            own = used[k:k + RUN]
            share = np.repeat(g_word[own] / g_len[own], g_kept[own])
            g_s += np.bincount(gram[ranges(g_at[own], g_kept[own])], share, minlength=len(e))
        g_s[0] = 0
        g_e, g_w = np.outer(g_s, w), e.T @ g_s
        g_e += decay * e
        e -= adam(t, 0, g_e)
        e[0] = 0
        w = w - adam(t, 2, g_w)
        b = b - adam(t, 4, delta.sum())
    _, seg = forward()
    z = np.maximum.reduceat(seg, seg_first) + b
    weight = np.zeros(BUCKETS, np.float32)
    weight[known] = (e @ w)[1:]
    prior = np.where(y > 0, class_share / y.mean(), (1 - class_share) / (1 - y.mean()))
    slope, offset = platt(z, y, prior)
    return Model(weight, float(b), float(np.median(z[y == 0])), slope, offset)


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit of the label on one number (Newton, slightly smoothed)."""
    center, scale = z.mean(), max(z.std(), 1e-6)
    x = np.column_stack([(z - center) / scale, np.ones(len(z))])
    target = np.where(y > 0, 0.995, 0.005)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (target - p)) - 1e-3 * beta)
        beta += np.clip(step, -2, 2)
    slope = max(float(beta[0]), 1e-6) / scale
    return slope, float(beta[1]) - slope * float(center)


def held_out(modulus: int, fold: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == fold, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training, sample_rows: int,
                    sample_bytes: int) -> tuple[pa.Array, np.ndarray, float]:
    """At most ``sample_rows`` whole texts of each class, in order of a hash of doc_id until a class has
    ``sample_rows * sample_bytes`` bytes (its first text is always in), and label 1's share."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
             .select("doc_id", F.col(label).cast("int").alias("y")).filter(training)
             .groupBy("doc_id").agg(F.max("y").alias("y")))
    n, n1 = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    texts = id_text(docs).filter(F.col("text").isNotNull())
    sized = known.join(texts.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("bytes")), "doc_id")
    picked = [sized.filter(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
              .withColumn("before", F.sum("bytes").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")) - F.col("bytes"))
              .filter(F.col("before") < sample_rows * sample_bytes).select("doc_id", "y") for k in (0, 1)]
    rows = picked[0].unionByName(picked[1])              # at most 2 * sample_rows rows
    found = (texts.join(F.broadcast(rows), "doc_id")
             .select("doc_id", "text", "y").orderBy("doc_id", "text").limit(2 * sample_rows).toArrow())
    return found.column("text").combine_chunks(), found.column("y").to_numpy().astype(float), n1 / n if n else 0.0


def fit(docs: DataFrame, labels: DataFrame, training, sample_rows: int = 1500,
        sample_bytes: int = 1 << 13) -> Model:
    return train(*labelled_sample(docs, labels, "toxic", training, sample_rows, sample_bytes))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score of every row; ``keep`` names further columns to carry along (a column named
    score is the new one, whatever ``keep`` says)."""
    keep = tuple(c for c in keep if c != "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       *[F.col(c) for c in keep if c not in ("doc_id", "text")])
    out = [c for c in rows.columns if c != "text" or "text" in keep]
    schema = rows.select(*out).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, "text")):
            z = shared.value.log_odds(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in out] + [pa.array(shared.value.probability(z))], names=[*out, "score"])

    return rows.mapInArrow(tidy(run), schema)
