"""Exact top-k search, source divergence and fill-in-middle against brute force, with the defined cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlens.llm import divergence, exact_topk, infill

# --- top-k ----------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, at string, weight int"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS).repartition(parts)


def nearest(rows, k, modulus=5):
    whole = {(i, tuple(max(-exact_topk.LIMIT, min(exact_topk.LIMIT, math.floor(256 * float(np.float32(x))))) for x in v))
             for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted({i for i, _ in whole if i % modulus == 0}):
        own = min((v for i, v in whole if i == q), key=lambda v: ([j for j, x in enumerate(v) if x], [x for x in v if x]))
        found = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in whole if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return out


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("seed, unit", [(1, 1 << 22), (2, 64), (3, 1)])
def test_topk_equals_brute_force(spark, monkeypatch, seed, unit):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(exact_topk, "SCORES", 200)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.01 if i % 3 else 0.2, 6)]) for i in rng.permutation(60)]
    rows += [(100 + i, rows[0][1]) for i in range(25)]                        # a group of copies: ties
    rows += [(200, None), (205, [1.0, None, 2.0]), (210, [float("nan")] * 6), (215, [float("inf"), 1.0]), (None, [1.0] * 6),
             (220, []), (225, [0.0] * 6), (230, [1.0, 2.0]), (235, [1e30, -1e30, 3.0]), (240, [0.5] * 6), (240, [0.5] * 6),
             (245, [0.25] * 6), (245, [0.5] * 6)]
    df = vectors(spark, rows)
    assert got(exact_topk.search(df, F.col("vec_id") % 5 == 0, 4, unit=unit)) == nearest(rows, 4)


def test_topk_small_tables(spark):
    assert got(exact_topk.search(vectors(spark, []), F.col("vec_id") % 5 == 0)) == []
    assert got(exact_topk.search(vectors(spark, [(5, [1.0])]), F.col("vec_id") % 5 == 0)) == []
    assert got(exact_topk.search(vectors(spark, [(5, [1.0]), (6, [2.0]), (3, [2.0])]), F.col("vec_id") % 5 == 0)) == [
        (5, 1, 3, 512 * 256), (5, 2, 6, 512 * 256)]


def test_best_takes_ties_by_place():
    assert exact_topk.best(np.array([3, 9, 3, 9, 3, 1]), 4).tolist() == [1, 3, 0, 2]
    assert exact_topk.best(np.array([1, 2]), 5).tolist() == [1, 0]


# --- divergence -----------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n long, term string, p long"


def audited(rows, min_docs=10, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in rows]
    df, n, group = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for (_, lang, source), w in zip(rows, terms):
        df[lang].update(set(w))
        n[lang].update(w)
        group[lang, source].update(w)
    out = []
    for (lang, source) in list(group):
        kept = [t for t, k in df[lang].items() if k >= min_docs]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = shares(group[lang, source]), shares(n[lang])
        parts = {"pair": [(s, sum(f(p[t], shares(group[lang, s])[t]) for t in kept)) for l, s in group if l == lang and s != source],
                 "term": [(t, f(p[t], q[t])) for t in kept if group[lang, source][t] and p[t] > q[t]]}
        for part, items in parts.items():
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, i, v, k + 1) for k, (i, v) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


@pytest.mark.parametrize("seed, pairs", [(1, 1 << 20), (2, 3)])
def test_divergence_equals_brute_force(spark, monkeypatch, seed, pairs):
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    monkeypatch.setattr(divergence, "ROWS", 30 * pairs)
    rng = random.Random(seed)
    words = ["The", "of", "é", "Ünd", "日本", "a1b", "x-y", "tion", "q", "Z"]
    text = lambda: " ".join(rng.choice(words) * rng.randint(1, 2) for _ in range(rng.randint(0, 12)))
    rows = [(text(), rng.choice(["en", "de"]), rng.choice(["a", "b", "B", "é"])) for _ in range(90)]
    rows += [rows[0]] * 40 + [(rows[0][0], "en", s) for s in "ab" * 20]        # copies within and over sources
    rows += [(None, "en", "empty"), ("", None, None), ("12 34", "fr", "s"), ("one", "fr", None), ("w" * 70000 + " of", "en", "a"),
             ("of " * 5000, "de", "b"), (text(), None, "a"), (None, "de", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(1, *r, 3, "x", 4) for r in rows], DOCS).repartition(3)
    found = divergence.audit(df, min_docs=6, top=4)
    assert sorted(tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect()) == audited(rows, 6, 4)
    assert divergence.audit(df.limit(0)).collect() == []


def test_divergence_of_sources_without_kept_terms(spark):
    df = spark.createDataFrame([(1, "one two", "en", s, 3, "x", 4) for s in "abc"], DOCS)
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == [
        ("en", s, "pair", o, 0, k + 1) for s in "abc" for k, o in enumerate(x for x in "abc" if x != s)]


# --- fill in the middle ---------------------------------------------------------------

def rearranged(doc_id, text):
    text = text or ""
    u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in infill.SENTINELS) or h3 % 100 >= 50:
        return doc_id, len(u), "plain", None, None, text, text
    spm = h4 % 100 < 80
    return (doc_id, len(u), "spm" if spm else "psm", len(p), len(m),
            f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", text)


def test_infill_equals_brute_force(spark, documents):
    rng = random.Random(5)
    text = lambda k: "".join(rng.choice([" ", "\n", "\t\x0b", "é", "a", "日", "<", ">", "S", "<S", "\x1f", "\x00"]) for _ in range(k))
    rows = [(i, text(rng.randint(0, 60))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "x"), (204, "a <P> b"), (205, "<M>"), (None, "a null id"), (None, None),
             (206, "long word " * 200_000), (207, "w" * 500_000), (208, "same"), (208, "same"), (-5, "minus one two")]
    found = infill.restore(infill.transform(documents(rows)))
    assert sorted(map(tuple, found.collect()), key=str) == sorted((rearranged(*r) for r in rows), key=str)
    assert {r["form"] for r in found.collect()} == {"plain", "psm", "spm"}
    assert infill.restore(infill.transform(documents(rows).limit(0))).collect() == []


def test_infill_rates_and_sentinels(documents):
    rows = [(i, f"one two three <P> {i}") for i in range(40)]
    names = ("<pre>", "<suf>", "<mid>")
    found = infill.restore(infill.transform(documents(rows), 7, 100, 0, names), names).collect()
    assert {r["form"] for r in found} == {"psm"}
    assert sorted((r["doc_id"], r["restored"]) for r in found) == rows
    with pytest.raises(ValueError):
        infill.transform(documents(rows), sentinels=("<a>", "<a>", "<b>"))
    with pytest.raises(ValueError):
        infill.transform(documents(rows), sentinels=("|", "<a>", "<b>"))
