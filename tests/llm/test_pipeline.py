"""The pipeline's stages, and the whole run, against brute force on a corpus with planted cases."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from demandlens.llm import toxicity
from demandlens.llm.tokens import encoder, tokenizer_path

from .test_models import LABELS, planted
from .test_text_dedup import ITEMS, linked, low, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row__ long, tk string, part int"


def corpus():
    """Toxic and clean texts, near copies, shared passages, benchmark passages and the defined cases."""
    rng = random.Random(11)
    rows, labels = planted(240, 3)
    clean = [t for (_, t), (_, _, toxic, _) in zip(rows, labels) if not toxic]
    syllables = ["tha", "on", "er", "ing", "st"]
    fresh = lambda k: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 5))) for _ in range(k))
    item, passage = fresh(14), fresh(40)
    long_ = fresh(4000)
    for i in range(12):
        t = fresh(60).split(" ")
        rows += [(1000 + 3 * i, " ".join(t)), (1001 + 3 * i, " ".join(t[:59] + ["edited"])), (1002 + 3 * i, f"{fresh(3)} {passage}\n{fresh(9)}")]
    rows += [(1100 + i, f"{fresh(20)} {item.upper() if i % 2 else item} {fresh(20)}") for i in range(5)]
    rows += [(1200, None), (1201, ""), (1202, " \n\t"), (1203, "one"), (1204, long_), (1205, long_ + " more"), (None, fresh(30)),
             (None, None), (1206, clean[0]), (1207, passage), (1208, "same " * 30), (1208, "same " * 30), (1209, ""), (1209, "")]
    rng.shuffle(rows)
    return rows, labels, [(1, item), (2, None), (3, ""), (4, "two words"), (None, fresh(12))]


def near_duplicates(rows):
    _, comp, sets = linked(rows, 5, 80, 100)
    order = lambda r: (r[0] is None, r[0] or 0)
    least = {}
    for r, c, s in zip(rows, comp, sets):
        if s and (c not in least or order(r) < order(least[c])):
            least[c] = r
    return [r for r, s in zip(rows, sets) if not s] + list(least.values())


def without_repeats(rows, n=13):
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            first[tuple(w[k:k + n])] = min(first.get(tuple(w[k:k + n]), order(i)), order(i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {j for k in range(len(w) - n + 1) if first[tuple(w[k:k + n])] < order(i) for j in range(k, k + n)}
        if not gone:
            out.append((i, t or ""))                       # a null text comes out empty
        elif len(gone) < len(w):
            out.append((i, b" ".join(x for j, x in enumerate(w) if j not in gone)))     # what lies between may differ
    return out


def decontaminated(rows, items, n=10):
    windows = {tuple(w[k:k + n]) for _, t in items if (w := low(t)) for k in range(max(1, len(w) - n + 1))}
    sizes = {len(x) for x in windows}
    return [(i, t) for i, t in rows if not any(tuple(w[k:k + s]) in windows for w in [low(t)] for s in sizes for k in range(len(w) - s + 1))]


def pieces(rows, capacity=2048):
    out = []
    for i, t in rows:
        ids = [*encoder(tokenizer_path()).tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[a:a + capacity], "<u4")
            out.append((i, k, a, len(own), zlib.crc32(own.tobytes())))
    return out


def table(rows):
    return sorted(((i, t) for i, t in rows), key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels, items = corpus()
    at = str(tmp_path_factory.mktemp("pipeline"))
    full = [(i, t, "en", "src", len(t or ""), 0.5, 7, "x", 1) for i, t in rows]
    spark.createDataFrame(full, DOCS).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(*r, "x") for r in items], ITEMS).write.parquet(f"{at}/benchmark.parquet")
    return at, rows, labels, items


def test_every_stage_and_the_run_equal_brute_force(spark, folder):
    at, rows, labels, items = folder
    docs, stages = spark.read.parquet(f"{at}/documents.parquet"), dict(corpus_pipeline.STAGES)
    got = {}
    for name in stages:
        docs = corpus_pipeline.written(stages[name](spark, docs, at), f"test-{name}")
        got[name] = docs.collect()
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    kept = {n: [(r["doc_id"], r["text"]) for r in got[n]] for n in list(stages)[:4]}

    # toxicity: the trained model decides, by whole texts; it must know the planted words
    out = toxicity.held_out(5, 0)
    model = toxicity.fit(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"), ~out)
    score = [model.probability(model.log_odds(pa.array([t], pa.string())))[0] for _, t in rows]
    assert table(kept["toxicity"]) == table(r for r, s in zip(rows, score) if s < 0.5)
    vile = {i for i, _, toxic, _ in labels if toxic}
    left = {i for i, _ in kept["toxicity"]}
    assert len(vile & left) < 0.1 * len(vile) and len(left) > 0.95 * len({i for i, _ in rows} - vile)

    assert table(kept["near_duplicates"]) == table(near_duplicates(kept["toxicity"]))
    want, found = without_repeats(kept["near_duplicates"]), kept["substring_dedup"]
    whole = {(i, t) for i, t in want if not isinstance(t, bytes)}
    assert table((i, t if (i, t) in whole else b" ".join(words(t))) for i, t in found) == table(want)
    assert all(r["n_chars"] == len(r["text"] or "") for r in got["substring_dedup"])
    assert table(kept["decontamination"]) == table(decontaminated(kept["substring_dedup"], items))
    assert [len(kept[n]) for n in kept] == sorted({len(kept[n]) for n in kept}, reverse=True)     # each takes some away

    run = corpus_pipeline.run(spark, at).collect()
    want = pieces(kept["decontamination"])
    for found in (got["packing"], run):
        assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found if r["doc_id"] is not None) == sorted(
            p for p in want if p[0] is not None)
        assert len(found) == len(want)
        bins = {}
        for r in found:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in bins.values():
            own.sort()
            assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 2048


def test_stages_of_an_empty_table(spark, folder):
    at, *_ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, at), f"none-{name}")
        assert docs.count() == 0


@pytest.mark.parametrize("labels", [[], [(i, 1, 1, 0) for i in range(20)]])
def test_nothing_goes_for_toxicity_without_both_classes(spark, tmp_path, documents, labels):
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents([(i, "scummy") for i in range(5)])
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == list(corpus_pipeline.COLUMNS) and kept.count() == 5
