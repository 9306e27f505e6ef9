"""Quality classifier: random Fourier features over document statistics, ridge scores from
partition-summed normal equations, isotonic calibration.

Statistics of each whole text (character classes, word and line shapes, repetition) are
standardised on the training rows and mapped to cosines of random projections, which
approximate a Gaussian kernel. Each partition of the training rows sums its normal equations a
fold; the driver adds at most ``TASKS`` times ``FOLDS`` small matrices and solves them. Each
training row is scored by the folds it is not in; those scores, binned in Spark, give the
isotonic (pool-adjacent-violators) map from ridge score to probability. All labelled training
rows take part, whatever their number.

Defined cases: a null text counts as empty and is scored from its statistics like any other; a
null doc_id is held out; repeated rows are scored each; of contradicting labels the larger
holds; null labels teach nothing; without labels of both classes every score is the share of
label 1 (0 without labels); only doc_id and text are read from documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, text_bytes, written

FEATURES, FOLDS, TASKS, BINS = 192, 5, 64, 1000
RIDGE = 0.3

_CLASS = np.zeros(256, dtype=np.int64)           # 0 other
for _k, _bytes in enumerate([bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b" ", b"\n\r", b"\t\x0b\x0c",
                             b".,;:?'\"()-", b"!", b"|", b"#$%&*@^~_=+<>/\\[]{}`"], 1):
    _CLASS[list(_bytes)] = _k
_CLASS[128:] = 11
STATISTICS = ("log_bytes", "log_words", "lower", "upper", "digit", "space", "newline", "tab", "mark", "bang", "bar",
              "symbol", "high", "control", "word_mean", "word_sd", "word_longest", "distinct", "top_word",
              "symbol_words", "upper_words", "lines", "line_mean", "line_repeats", "half_repeats", "stop_gap")


def statistics(text: bytes) -> list[float]:
    """The numbers a whole text is judged by, all finite, also for an empty text."""
    n = max(len(text), 1)
    by_class = np.bincount(_CLASS, np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=12) / n
    words = text.split()
    k = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    count = Counter(words)
    distinct = len(count)
    top = max(count.values(), default=0)
    tails = Counter(w[-1:] for w in count.elements()) if distinct else Counter()
    symbol_words = sum(v for c, v in tails.items() if c in b"#$%&*!|@^~=+<>/" and c)
    upper_words = sum(v for w, v in count.items() if len(w) > 1 and w.isupper())
    lines = [x for x in text.split(b"\n") if x.strip()]
    kinds = len(set(lines))
    half = len(words) // 2
    again = len(set(words[:half]) & set(words[half:])) / max(1, min(half, distinct)) if half else 0.0
    gaps = float(np.abs(np.diff(sizes)).mean()) if len(sizes) > 1 else 0.0
    return [np.log1p(len(text)), np.log1p(len(words)), by_class[1], by_class[2], by_class[3], by_class[4],
            by_class[5], by_class[6], by_class[7], by_class[8], by_class[9], by_class[10], by_class[11], by_class[0],
            float(sizes.mean()), float(sizes.std()), float(np.log1p(sizes.max())), distinct / k, top / k,
            symbol_words / k, upper_words / k, np.log1p(len(lines)), float(np.log1p(n / max(1, len(lines)))),
            1 - kinds / max(1, len(lines)), again, gaps]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and one float column a statistic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in text_bytes(batch.column(1))], dtype=np.float64)
            x = x.reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, i]) for i in range(x.shape[1]))],
                                             names=["doc_id", *STATISTICS])

    return id_text(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in STATISTICS))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    beta: np.ndarray | None         # a column a fold left out, and the last from all rows
    knots: np.ndarray               # isotonic map: ridge score -> probability
    values: np.ndarray
    constant: float = 0.0

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / FEATURES) * np.cos(z @ self.projection + self.phase)
        return np.column_stack([waves, 0.1 * z, np.ones(len(z))])

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(x), self.constant)
        raw = self.features(x) @ self.beta[:, -1]
        # a thousandth of the raw score keeps the order within the isotonic steps
        return np.clip(0.999 * np.interp(raw, self.knots, self.values) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATISTICS])


def isotonic(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing means nearest to the bins' means."""
    blocks: list[list[float]] = []
    for s, n in zip(sums.tolist(), counts.tolist()):
        blocks.append([s, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s1, n1, k1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s1, blocks[-1][1] + n1, blocks[-1][2] + k1]
    return np.concatenate([np.full(int(k), s / n) for s, n, k in blocks])


def fit(stats: DataFrame, labels: DataFrame, training, seed: int = 11) -> Model:
    """Train from the labelled rows that ``training`` (a condition on doc_id) allows."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
             .select("doc_id", F.col("quality").cast("double").alias("y")).filter(training)
             .groupBy("doc_id").agg(F.max("y").alias("y")))
    rows = written(stats.join(known, "doc_id")
                   .withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")), "quality-train")
    first = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"),
                     *[F.avg(c).alias(f"m_{c}") for c in STATISTICS],
                     *[F.stddev_pop(c).alias(f"s_{c}") for c in STATISTICS]).first()
    d, rng = len(STATISTICS), np.random.default_rng(seed)
    projection, phase = rng.normal(0, 1 / np.sqrt(d), (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    mean = np.array([first[f"m_{c}"] or 0.0 for c in STATISTICS])
    scale = np.array([max(first[f"s_{c}"] or 0.0, 1e-6) for c in STATISTICS])
    model = Model(mean, scale, projection, phase, None, np.zeros(1), np.zeros(1), float(first["y"] or 0.0))
    if not first["n"] or first["y"] in (0.0, 1.0):
        return model
    width = FEATURES + d + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, width, width + 1))
        for batch in batches:
            a, y = model.features(_matrix(batch)), batch.column("y").to_numpy(zero_copy_only=False)
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for k in range(FOLDS):
                own = fold == k
                total[k] += a[own].T @ np.column_stack([a[own], y[own]])
        for k in range(FOLDS):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k].tobytes()])],
                                             names=["fold", "sums"])

    sums = np.zeros((FOLDS, width, width + 1))
    for r in rows.coalesce(TASKS).mapInArrow(equations, "fold int, sums binary").toLocalIterator():
        sums[r["fold"]] += np.frombuffer(r["sums"]).reshape(width, width + 1)
    whole = sums.sum(axis=0)
    penalty = RIDGE * np.eye(width)
    penalty[-1, -1] = 1e-9
    parts = [whole - sums[k] for k in range(FOLDS)] + [whole]
    model.beta = np.column_stack([np.linalg.solve(m[:, :-1] + penalty, m[:, -1]) for m in parts])

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.features(_matrix(batch)) @ model.beta
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            own = np.clip(raw[np.arange(len(fold)), fold], -0.5, 1.5)
            yield pa.RecordBatch.from_arrays([pa.array(((own + 0.5) * (BINS / 2)).astype(np.int32)), batch.column("y")],
                                             names=["bin", "y"])

    bins = (rows.mapInArrow(outside, "bin int, y double").groupBy("bin")
            .agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("bin").collect())     # at most BINS + 1 rows
    n = np.array([r["n"] for r in bins], float)
    model.knots = (np.array([r["bin"] for r in bins]) + 0.5) / (BINS / 2) - 0.5
    model.values = isotonic(np.array([r["y"] for r in bins], float), n)
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row of the statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.probability(_matrix(batch)))],
                                             names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, training) -> DataFrame:
    stats = written(with_statistics(docs), "quality-stats")
    return score(stats, fit(stats, labels, training))
