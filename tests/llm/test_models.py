"""Classifiers on planted signals, held-out accuracy, and the learned nearest-neighbour index."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlens.llm import ann, quality, toxicity

LABELS = "doc_id long, quality int, toxic int, y int"


def planted(n=400, seed=1):
    rng = random.Random(seed)
    plain = lambda: "".join(rng.choice(["tha", "on", "er", "ing", "st"]) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(n):
        words, bad, vile = [plain() for _ in range(rng.randint(5, 120))], rng.random() < 0.3, rng.random() < 0.25
        if vile:
            for _ in range(rng.randint(2, 5)):
                words[rng.randrange(len(words))] = "scumm" + rng.choice(["y", "ier", "o", plain()])
        if bad:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(vile), 9))
    return rows, labels


def test_quality_separates_held_out_rows(spark, documents):
    rows, labels = planted()
    out = toxicity.held_out(4, 2)
    extra = [(3, None, None, 1), (None, 1, 1, 1), (9999, 1, 0, 1), labels[4]]
    got = quality.classify(documents(rows + [(None, "x"), (5000, None), (5001, ""), (5001, "")]),
                           spark.createDataFrame(labels + extra, LABELS), ~out).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: q for i, q, _, _ in labels}
    held = [r for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([(r["score"] >= 0.7) == truth[r["doc_id"]] for r in held]) > 0.95


def test_isotonic_is_the_monotone_fit():
    got = quality.isotonic(np.array([0, 1, 0, 2, 1.0]), np.array([1, 1, 1, 2, 1.0]))
    assert got.tolist() == [0, 0.5, 0.5, 1, 1] and (np.diff(got) >= 0).all()
    assert quality.isotonic(np.array([3.0, 0.0]), np.array([3.0, 1.0])).tolist() == [0.75, 0.75]


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_without_labels_or_documents(spark, documents, operator):
    none, out = spark.createDataFrame([], LABELS), toxicity.held_out(4, 2)
    one = spark.createDataFrame([(i, 1, 1, 0) for i in range(20)], LABELS)
    for labels, score in ((none, 0.0), (one, 1.0)):
        for rows in ([], [(1, "a b"), (2, None)]):
            docs = documents(rows)
            if operator is quality:
                got = quality.classify(docs, labels, ~out).collect()
            else:
                got = toxicity.score(docs, toxicity.fit(docs, labels, ~out)).collect()
            assert len(got) == len(rows)
            assert all(r["score"] in (score, 0.0) for r in got)


def test_toxicity_finds_unseen_inflections_in_long_texts(spark, documents):
    rows, labels = planted(600, 2)
    docs, out = documents(rows), toxicity.held_out(5, 0)
    model = toxicity.fit(docs, spark.createDataFrame(labels, LABELS), ~out)
    truth = {i: t for i, _, t, _ in labels}
    got = toxicity.score(docs, model, keep=("lang", "part", "score")).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["score"] >= 0.5) == truth[r["doc_id"]] for r in held]) > 0.95
    long = "tha oner sting " * 3000
    extra = {r["doc_id"]: r["score"] for r in toxicity.score(documents([
        (1, long), (2, long + "scummish scummette " + long), (3, None), (4, " \n"), (None, "tha")]), model).collect()}
    assert extra[2] > 0.5 > extra[1] and extra[3] == extra[4] < 0.5 and None in extra


def test_toxicity_learns_from_long_labelled_texts(spark, documents):
    """All labelled texts, or all toxic ones, are longer than 16 KB."""
    rows, labels = planted(120, 4)
    rows = [(i, t + " tha oner sting" * 1200) for i, t in rows]
    docs, out = documents(rows), toxicity.held_out(5, 0)
    made = spark.createDataFrame(labels, LABELS)
    texts, y, _ = toxicity.labelled_sample(docs, made, "toxic", ~out, 1500, 1 << 14)
    assert len(texts) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rows) and 0 < y.mean() < 1
    few, y, _ = toxicity.labelled_sample(docs, made, "toxic", ~out, 10, 1 << 13)       # 80 KB a class
    assert sorted(y) == [0] * 5 + [1] * 5 and all(len(t) > 1 << 14 for t in few.to_pylist())


def test_held_out_is_the_contract(spark):
    rows = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    got = {r["doc_id"]: r["h"] for r in rows.select("doc_id", toxicity.held_out(5, 0).alias("h")).collect()}
    assert got.pop(None) and got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


# --- nearest neighbours -----------------------------------------------------------------

EMBEDDINGS = "vec_id long, embedding array<float>, label int, key string, score double"


def vectors(n=900, d=16, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(30, d))
    x = (centers[rng.integers(0, 30, n)] + 0.4 * rng.normal(size=(n, d))).astype(np.float32)
    x[100:400] = x[7]                                   # a large group of copies
    return x


def exact(rows, k):
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], np.float64)
    out = {}
    for q in range(len(ids)):
        if ids[q] % 20 == 0:
            s = (x * x[q]).sum(axis=1)
            best = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != ids[q])[:k]
            out[ids[q]] = [(i, -v) for v, i in best]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "k", 0.5)
                                for i, v in rows], EMBEDDINGS).repartition(3)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return got


def test_recall_scores_and_copies(spark):
    rows = list(enumerate(vectors()))
    got, want = run(spark, rows), exact(rows, 20)
    assert got.keys() == want.keys()
    recall = []
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [i for _, i, _ in found]
        x = np.array([v for _, v in rows], np.float64)
        assert all(abs(s - float(x[q] @ x[i])) < 1e-9 for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        recall.append(len({i for _, i, _ in found} & {i for i, _ in want[q]}) / 20)
    assert np.mean(recall) >= 0.95
    copies = [i for i in got if 100 <= i < 400]
    assert copies and all([i for _, i, _ in got[q]][:5] == [j for j, _ in want[q]][:5] for q in copies)


def test_small_and_unusable_vectors(spark):
    e = np.eye(3)
    rows = [(0, e[0]), (1, e[0] + e[1]), (2, e[1]), (3, e[0]), (40, e[1]), (40, e[1]), (60, e[2] * 0), (80, None), (100, [1, None, 0]),
            (120, [float("nan"), 1, 0]), (140, [float("inf"), 1, 0]), (160, []), (180, [1, 2]), (None, e[0])]
    got = run(spark, rows)
    assert got == {0: [(1, 1, 1.0), (2, 3, 1.0), (3, 2, 0.0), (4, 40, 0.0)],
                   40: [(1, 1, 1.0), (2, 2, 1.0), (3, 0, 0.0), (4, 3, 0.0)]}
    assert run(spark, []) == {} and run(spark, [(0, e[0])]) == {}


def test_parts_are_balanced():
    x = vectors(1200)[400:]
    graph = ann.neighbours(x.astype(float), 8)
    label = ann.balanced_parts(graph, 10, np.random.default_rng(0))
    sizes = np.bincount(label, minlength=10)
    assert sizes.min() > 0 and sizes.max() <= np.ceil(1.1 * len(x) / 10)
    assert (label[graph] == label[:, None]).mean() > 0.5
