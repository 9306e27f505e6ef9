"""Substring dedup, suffix columns, decontamination and the Jaccard join against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from demandlens.llm import columns, decontaminate, exchange, graph, jaccard, substring, suffixes

VOCABULARY = ["the", "of", "And", "tion", "é", "ß,", "x.", "ing", "no", "Y"]


def corpus(seed, n=40, longest=60):
    """Random texts with copies, near copies, shared passages and the defined cases."""
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(VOCABULARY) + str(rng.randint(0, 60)) for _ in range(k))
    passage, rows = text(20), []
    for i in range(n):
        kind, t = rng.random(), text(rng.randint(0, longest))
        if kind < 0.25 and rows:
            t = rng.choice(rows)[1] or ""
        elif kind < 0.5 and rows:
            words = (rng.choice(rows)[1] or "").split(" ")
            words[rng.randrange(len(words))] = "edited"
            t = " ".join(words)
        elif kind < 0.7:
            t = f"{t}\n {passage}\t{text(3)}"
        rows.append((i * 7 % (2 * n), t))
    rows += [(901, None), (902, ""), (903, " \n\t\x0b "), (904, "one"), (905, "two words"), (None, passage), (None, text(30)),
             (906, text(4) + " " + "w " * 3000), (907, rows[0][1]), (907, rows[0][1]), (908, "a\x1fb " + passage.upper())]
    rng.shuffle(rows)
    return rows


def words(text):
    return (text or "").encode().split()


# --- substring ------------------------------------------------------------------------

def removed_words(rows, n):
    first = {}
    order = lambda i: float("inf") if i is None else i
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k:k + n])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k:k + n])] < order(i):
                gone.update(range(k, k + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed,window", [(1, 13), (2, 3)])
def test_substring_equals_brute_force(documents, monkeypatch, seed, window):
    rows = corpus(seed)
    got = substring.remove(documents(rows), window, keep=("lang",)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == removed_words(rows, window)
    texts = {(i, t) for i, t in rows}
    for r in got:
        assert r["lang"] == "en" and len(words(r["text"])) == r["n_words"] - r["n_removed"]
        assert sum(s["words"] for s in r["spans"]) == r["n_removed"]
        if not r["n_removed"]:
            assert (r["doc_id"], r["text"] or None) in {(i, t or None) for i, t in texts}


def test_substring_empty(documents):
    assert substring.remove(documents([])).count() == 0
    assert [r["n_words"] for r in substring.remove(documents([(1, None)])).collect()] == [0]


def test_packed_gaps():
    rng = np.random.default_rng(3)
    for size, top in ((0, 5), (1, 10 ** 6), (1000, 1 << 22), (5000, 6000), (40, 1 << 22)):
        x = np.unique(rng.integers(0, top, size))
        assert (exchange.unpack_sorted(exchange.pack_sorted(x)) == x).all()
    assert exchange.unpack_sorted(exchange.pack_sorted(np.array([0, 255, 256, 65_535, 65_536 + 65_535]))).tolist() == [
        0, 255, 256, 65_535, 131_071]


# --- suffix columns -------------------------------------------------------------------

def removed_bytes(rows, n):
    count = {}
    for _, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            count[b[k:k + n]] = count.get(b[k:k + n], 0) + 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - n + 1):
            if count[b[k:k + n]] > 1:
                gone[k:k + n] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((str(i), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffixes_equal_brute_force(documents, monkeypatch, hot):
    rows = corpus(5, 25) + [(950, "q" * 700), (951, "q" * 300 + "r" + "q" * 420), (952, "ab" * 300)]
    # functions of the module travel by name to the workers: the split of hot anchors is tested on its own
    if hot == 1:
        check_hot_ranges([(t or "").encode() for _, t in rows])
        return
    got = suffixes.remove(documents(rows), 90).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
                  for r in got) == removed_bytes(rows, 90)


def check_hot_ranges(texts, length=90):
    c = suffixes.Contexts(texts, length)
    everything = np.ones(len(c.key), bool)
    starts = lambda p: np.concatenate([np.arange(a, b) for a, b in zip(p[0], p[1])])
    plain, split = c.pieces(everything, ~everything, length), c.pieces(everything, everything, length)
    assert (np.sort(starts(plain)) == np.sort(starts(split))).all()        # every string in one piece
    for pieces in (plain, split):                                          # equal strings share a route
        route = {}
        for a, b, r in zip(*pieces):
            for s in range(a, b):
                assert route.setdefault(c.data[s:s + length], r) == r


def headers(n=30, length=90):
    """Texts that share a header of more than ``length`` bytes and go on each in its own way, some alike."""
    rng = random.Random(9)
    header = " ".join(f"licence{k}" for k in range(20))
    return [(3000 + i, f"{header} {rng.randint(0, n // 2)} own " + " ".join(str(rng.random()) for _ in range(12)))
            for i in range(n)]


def test_suffixes_with_crowded_routes_equal_brute_force(documents):
    rows = corpus(5, 15) + headers()
    got = suffixes.remove(documents(rows), 90, 3).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
                  for r in got) == removed_bytes(rows, 90)


def test_what_runs_over_a_shared_header_is_not_one_route(length=90):
    c = suffixes.Contexts([t.encode() for _, t in headers()], length)
    everything, most = np.ones(len(c.key), bool), 3

    def distinct(pieces):
        held = {}
        for a, b, r in zip(*pieces):
            held.setdefault(r, set()).add(c.data[a:b - 1 + length])
        return {r: len(x) for r, x in held.items()}

    before = distinct(c.pieces(everything, everything, length))
    crowded = np.array([r for r, n in before.items() if n > most], np.uint64)
    pieces = c.pieces(everything, everything, length, crowded)
    assert len(crowded) and max(distinct(pieces).values()) <= most
    starts, route = [], {}
    for a, b, r in zip(*pieces):
        for s in range(a, b):
            starts.append(s)
            assert route.setdefault(c.data[s:s + length], r) == r       # equal strings still meet
    whole = c.pieces(everything, ~everything, length)
    assert sorted(starts) == sorted(s for a, b in zip(*whole[:2]) for s in range(a, b))


def test_suffixes_empty(documents):
    assert suffixes.remove(documents([])).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_columns_equal_brute_force(seed):
    rng = random.Random(seed)
    n = rng.choice([5, 8, 12, 20])
    base = bytes(rng.choice(b"ab cd\n") for _ in range(rng.randint(n, 80)))
    strings = set()
    for _ in range(rng.randint(1, 6)):
        s = bytearray(base[(a := rng.randrange(len(base))):a + rng.randint(n, 60)])
        if rng.random() < 0.5:
            s[rng.randrange(len(s))] = rng.choice(b"ab x")
        strings.add(bytes(s))
    strings = sorted(strings)
    times = np.array([rng.choice([1, 1, 2]) for _ in strings], float)
    count = {}
    for s, k in zip(strings, times):
        for i in range(len(s) - n + 1):
            count[s[i:i + n]] = count.get(s[i:i + n], 0) + k
    want = [i + n <= len(s) and count[s[i:i + n]] >= 2 for s in strings for i in range(len(s))]
    assert columns.repeated(strings, times, n).tolist() == [bool(x) for x in want]
    c = columns.Collection(strings, 1000)
    suffix, string, prefix = c.build()
    rows = [c.data.tobytes()[c.byte[x]:c.end_byte[y]] for x, y in zip(suffix, string)]
    assert rows == sorted(rows)
    for a, b, k in zip(rows, rows[1:], prefix[1:].tolist()):
        assert k == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


# --- decontamination ------------------------------------------------------------------

def low(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def hit_words(rows, items, n=10):
    windows = {}
    for i, t in items:
        w = low(t)
        for k in range(max(1, len(w) - n + 1)):
            if w:
                windows.setdefault(tuple(w[k:k + n]), set()).add(None if i is None else str(i))
    out = []
    for i, t in rows:
        w, gone, ids = low(t), set(), set()
        for k in range(len(w)):
            for size in {len(x) for x in windows}:
                found = windows.get(tuple(w[k:k + size]))
                if found and k + size <= len(w):
                    gone.update(range(k, k + size))
                    ids |= found
        out.append((str(i), len(w), len(gone), sorted(x for x in ids if x is not None)))
    return sorted(out)


ITEMS = "item_id long, text string, wid string"


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_decontamination_equals_brute_force(spark, documents, broadcast):
    rows = corpus(9)
    texts = [t for _, t in rows if t and len(t.split()) > 12]
    items = [(1, texts[0]), (2, "  ".join(texts[1].split()[3:9]).upper()), (10, texts[2] + " unseen words"), (3, None), (4, ""),
             (5, "two words"), (6, "one"), (7, "never seen at all"), (None, texts[3]), (1, texts[0]), (11, texts[0])]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        bench = spark.createDataFrame([(*x, "clash") for x in items], ITEMS)
        docs = documents(rows)
        got = decontaminate.report(docs, bench).collect()
        want = hit_words(rows, items)
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["item_ids"]) for r in got) == want
        kept = decontaminate.clean(docs, bench).collect()
        assert sorted(str(r["doc_id"]) for r in kept) == sorted(x[0] for x in want if not x[2])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_decontamination_empty(spark, documents):
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate.report(documents([]), none).count() == 0
    assert [r["n_hit"] for r in decontaminate.report(documents([(1, "a b c")]), none).collect()] == [0]


def test_decontamination_is_native(documents, spark):
    bench = spark.createDataFrame([(1, "a b c d", "x")], ITEMS)
    plan = decontaminate.report(documents([(1, "a b c d")]), bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- Jaccard join -----------------------------------------------------------------------

def shingle_set(text, n):
    w = [x.lower() if x.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words(text)]
    return {tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def linked(rows, n, num, den):
    sets = [shingle_set(t, n) for _, t in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
        if not changed:
            break
    ids = {}
    for (i, _), c in zip(rows, comp):
        ids.setdefault(c, []).append(i)
    least = {c: min((x for x in v if x is not None), default=None) for c, v in ids.items()}
    return sorted((str(i), len(s), str(least[c] if s else i)) for (i, _), s, c in zip(rows, sets, comp)), comp, sets


@pytest.mark.parametrize("seed,n,num", [(3, 4, 85), (4, 2, 60)])
def test_jaccard_equals_brute_force(documents, seed, n, num):
    rows = corpus(seed, 60)
    got = jaccard.join(documents(rows), n, num, 100).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == linked(rows, n, num, 100)[0]


def templates(seed=8, n=30):
    """Near and not so near copies of two long texts, so that most share their posted shingles."""
    rng, rows = random.Random(seed), []
    bodies = [[f"{c}{k}" for k in range(60)] for c in "xy"]
    for i in range(n):
        t = list(bodies[i % 2])
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(60)] = f"own{rng.randint(0, 9)}"
        rows.append((2000 + i, " ".join(t[:rng.randint(50, 60)])))
    return rows


@pytest.mark.parametrize("longest", [2, 5])
def test_jaccard_with_cut_lists_equals_brute_force(documents, longest):
    rows = corpus(3, 40) + templates()
    got = jaccard.join(documents(rows), 4, 85, 100, longest).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == linked(rows, 4, 85, 100)[0]


@pytest.mark.parametrize("others", [0, 30, 700, 1000])
def test_blocks_of_a_long_list_are_bounded_and_complete(others):
    """Every pair outside the largest component meets once, in groups of about two blocks."""
    n, longest = 1000, 100
    sig = np.random.default_rng(others).integers(-1 << 63, (1 << 63) - 1, n)
    comp = np.where(np.arange(n) < others, sig, 7)
    table = np.column_stack([sig, np.full(n, 50), comp, np.zeros(n, np.int64)])
    h, of = np.full(n, 99, np.uint64), np.arange(n)
    same = max(n - others, 1)
    lists = jaccard.Lists(np.array([99], np.uint64), *(np.array([x]) for x in (n, n, 7 if others < n else sig[0], same)))
    for round_ in (0, 1):
        (_, plain, _), (at, group, _) = jaccard._dealt(h, of, table, lists, longest, round_)
        assert not len(plain) and len(at) == n and np.unique(group, return_counts=True)[1].max() < 2 * longest
    got = [x for x in jaccard._dealt(h, of, table, lists, longest, None) if len(x[0])]
    at, group, side = (np.concatenate(x) for x in zip(*got)) if got else [np.zeros(0, np.int64)] * 3
    assert len(at) == lists.copies(longest)
    met = np.zeros((n, n), np.int64)
    for g in np.unique(group):
        own, s = at[group == g], side[group == g]
        assert len(own) < 4 * longest
        left, right = own[s & 1 > 0], own[s & 2 > 0]
        if (s == 3).all():
            met[np.ix_(left, right)] += np.triu(np.ones((len(own), len(own)), np.int64), 1)
        else:
            met[np.ix_(left, right)] += 1
    assert ((met + met.T)[np.triu_indices(n, 1)] == (comp[:, None] != comp)[np.triu_indices(n, 1)]).all()


def test_representatives_keep_one_row_a_component(documents):
    rows = corpus(6, 40)
    _, comp, sets = linked(rows, 5, 80, 100)
    got = jaccard.representatives(documents(rows)).collect()
    want = len({c for c, s in zip(comp, sets) if s}) + sum(not s for s in sets)
    assert len(got) == want and got[0].asDict().keys() >= {"lang", "tk", "score", "part"}
    clash = documents(rows).withColumn(jaccard.ROW, F.lit("own")).withColumn(jaccard.ROW.upper() + "_", F.lit(1))
    got = jaccard.representatives(clash).collect()
    assert len(got) == want and {r[jaccard.ROW] for r in got} == {"own"}


def test_class_numbers_are_distinct():
    """Class numbers come from row numbers by a bijection, so signatures of 128 bits are all that joins sets."""
    row = np.concatenate([np.arange(1000), (np.arange(1, 1001) << 33) + 5]).astype(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(row), pa.array([b""] * len(row))], names=["row", "shared"])
    got = next(jaccard._ranges(iter([batch])))
    assert got.schema.names == ["sig", "shared", "ranges"] and len(set(got.column("sig").to_pylist())) == len(row)


def test_links_equal_brute_force(documents):
    """All links, also those between sets of one component."""
    rows, held = corpus(3, 25) + templates(n=20), {}
    for (i, _), s in zip(rows, linked(rows, 4, 85, 100)[2]):
        if s:
            held.setdefault(frozenset(s), []).append(i)
    name = lambda own: (str(min((x for x in own if x is not None), default=None)), len(own))
    want = [sorted([name(held[a]), name(held[b])]) for a in held for b in held
            if id(a) < id(b) and 100 * len(a & b) >= 85 * len(a | b)]
    for longest in (2, 1000):
        got = jaccard.links(documents(rows), 4, 85, 100, longest).collect()
        assert sorted(sorted([(str(r["a_id"]), r["n_a"]), (str(r["b_id"]), r["n_b"])]) for r in got) == sorted(want)


def test_jaccard_empty(documents):
    assert jaccard.join(documents([])).count() == 0
    got = jaccard.join(documents([(1, None), (2, "")])).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(1, 0, 1), (2, 0, 2)]


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (2000, 1001), (-5, 300)]
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert {got[i] for i in range(301)} == {-5} and got[2000] == got[1001] == 1000


def test_suffix_least_of_neighbours_at_run_edges():
    """The sliding minimum in runs gives what one pass gives, at the runs' edges too."""
    import numpy as np
    from demandlens.llm.suffixes import _least
    rng = np.random.default_rng(5)
    for n, width, step in ((1, 1, 4), (7, 7, 4), (40, 5, 4), (41, 8, 16), (16 + 4, 5, 16), (16 + 5, 5, 16), (400, 337, 16)):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        assert (_least(x, width, step) == np.lib.stride_tricks.sliding_window_view(x, width).min(axis=1)).all()


def test_suffix_counts_of_symbols_are_kept_between_rounds(monkeypatch):
    """Each round is given the rows of every symbol so far; none counts all rows again."""
    import numpy as np
    from demandlens.llm import columns
    seen = []
    mapped = columns.Collection._mapped

    def watch(self, before, newest, total):
        seen.append((total == np.bincount(before, minlength=self.none + 1)).all())
        return mapped(self, before, newest, total)

    monkeypatch.setattr(columns.Collection, "_mapped", watch)
    text = b"one two three one two three four "
    found = columns.repeated([text, b"x " + text[:20], b"y"], np.ones(3), 12)
    whole = [text, b"x " + text[:20], b"y"]
    windows = [w[i:i + 12] for w in whole for i in range(len(w) - 11)]
    starts = [k + i for k, w in zip(np.cumsum([0, *map(len, whole)]), whole) for i in range(len(w) - 11)]
    want = np.zeros(sum(map(len, whole)), bool)
    want[[s for s, w in zip(starts, windows) if windows.count(w) > 1]] = True
    assert (found == want).all() and len(seen) > 3 and all(seen)
