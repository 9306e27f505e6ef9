"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. Partitions sketch in how many documents each shingle occurs (count-min, as sparse slices);
   the estimate and the hash order all shingles, rarest first, the same way everywhere.
   A shingle that is estimated to occur in one document can match nothing and is not posted.
2. Documents with the same set, by a 128-bit signature, are one class; a class has a number of its
   own, made from its first row's. A class posts the other shingles of its prefix
   (size - needed overlap + 1 rarest). Classes that share a posted shingle are candidates if
   their sizes allow the threshold (length) and so do their places in both orders (positional).
   So do the counts of their shared shingles in hash ranges, an upper bound of the overlap
   (suffix filter).
3. Distinct candidate pairs are verified once, exactly, on the sets.
4. Two classes that are already connected need no further link. So the first rounds only try
   neighbours in the posting lists, which connects groups of near copies with about as many
   links as members; the last round tries all candidates from different components. It finds
   every component, without all pairs of a large group.
5. A posting list of more than ``longest`` classes is cut by hashes of the classes: the first
   rounds try neighbours within a block; the last groups (shingle, block, block), so that each
   class outside the list's largest component meets every other in one group. A list of one
   component is not posted. In the last round a pair is kept at the first shingle both share,
   which leaves min(size - place) for the overlap; a list in which no class could reach the
   threshold with one of its own size from there holds no such pair and is not posted either.

Defined cases: null, empty or wordless texts have an empty set, no links and themselves as
component; texts of fewer words than a shingle are one shingle; a null doc_id takes part in
links but is no component's smallest id unless all its members are null; rows that share a
doc_id are separate documents; empty tables give no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, written, release, tidy
from .exchange import Block, answers, ask, blocks, pack_sorted, unpack_sorted
from .graph import components
from .substring import _cut
from .wordhash import groups, mix, words

DEPTH, LOAD, SLICE = 2, 4, 1 << 22
POSTINGS = 1 << 18          # about so many postings a bucket
LONGEST = 1 << 15           # classes of a posting list that is not cut
COPIES = 1 << 20            # postings of a batch that are dealt out at once
RANGES = 128                # hash ranges of the suffix filter
ROUNDS, REACH = 2, 2        # rounds among neighbours, neighbours tried on each side
ROW = "jaccard_row__"       # internal column, the last; another name where documents have it


def needed(a, b, num: int, den: int):
    """Least overlap of sets of sizes a and b with den * overlap >= num * union."""
    return -(-num * (a + b) // (num + den))


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every distinct shingle, in the texts' order."""
    docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for offset, own in groups(texts):
        w = words(own, lower=True)
        at, h = w.windows(n, 3)
        d = w.doc[at]
        short = np.flatnonzero((np.diff(w.first) > 0) & (np.diff(w.first) < n))
        whole = [int(mix(np.array([int.from_bytes(hashlib.blake2b(w.hash[w.first[i]:w.first[i + 1]].tobytes(),
                                                                  digest_size=8).digest(), "little")], np.uint64), 4)[0])
                 for i in short.tolist()]
        d, h = np.concatenate([d, short]), np.concatenate([h, np.array(whole, np.uint64)])
        order = np.lexsort((h, d))
        d, h = d[order], h[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        docs.append(d[new] + offset)
        hashes.append(h[new])
    return np.concatenate(docs), np.concatenate(hashes)


def _counters(h: np.ndarray, width: int) -> list[np.ndarray]:
    return [(mix(h, 10 + d) % np.uint64(width)).astype(np.int64) for d in range(DEPTH)]


def _blocks(width: int) -> int:
    return -(-width // SLICE)


def _sketch(h: np.ndarray, width: int) -> list[tuple[int, bytes, bytes]]:
    out = []
    for row, c in enumerate(_counters(h, width)):
        distinct, n = np.unique(c, return_counts=True)
        n = np.minimum(n, 255).astype(np.uint8)
        out += [(row * _blocks(width) + k, pack_sorted(distinct[own] - k * SLICE), n[own].tobytes())
                for k, own in _cut(distinct, SLICE)]
    return out


def _add_sketches(bucket: int, asked: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    total, places = np.zeros(SLICE, np.uint32), []
    for packed, n in asked:
        places.append(at := unpack_sorted(packed))
        total[at] += np.frombuffer(n, np.uint8)
    return [(np.minimum(total[at], 255).astype(np.uint8).tobytes(), b"") for at in places]


def _estimates(h: np.ndarray, width: int, path: str, block: Block) -> np.ndarray:
    """Estimated documents of each shingle (at most 255; the hash orders beyond that)."""
    found, least = answers(path, block), np.full(len(h), 255, np.uint8)
    for row, c in enumerate(_counters(h, width)):
        distinct, back = np.unique(c, return_inverse=True)
        counts = [np.frombuffer(found[row * _blocks(width) + k][0], np.uint8) for k, _ in _cut(distinct, SLICE)]
        if counts:
            least = np.minimum(least, np.concatenate(counts)[back])
    return least


SETS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("mark", pa.binary()), ("prefix", pa.binary()),
                  ("place", pa.binary()), ("often", pa.int64()), ("shared", pa.binary())])
SETS_DDL = "row long, doc_id long, n long, mark binary, prefix binary, place binary, often long, shared binary"


def numbered(docs: DataFrame) -> DataFrame:
    """The rows, written, with doc_id and text first and a number of their own last."""
    taken, key = {c.lower() for c in docs.columns}, ROW
    while key in taken:
        key += "_"
    first = {"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}
    rest = [F.col(c) for c in docs.columns if c not in first]
    return written(docs.select(*[v.alias(c) for c, v in first.items()], *rest, F.monotonically_increasing_id().alias(key)),
                   "jaccard-docs", compression="zstd")


def sets(table: DataFrame, n: int, num: int, den: int, longest: int = LONGEST) -> DataFrame:
    """Per row of a numbered table: size and signature of its set; the first of its class in a block also
    carries the posted prefix shingles, their places, how many of them (the last ones) may have more than
    ``longest`` postings, and all shingles estimated to be shared."""
    parts = table.select("doc_id", "text", F.col(table.columns[-1]).alias(ROW))
    total = parts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = max(1 << 16, LOAD * total // 6)         # about six bytes a word; only efficiency depends on it
    path = ask(parts, lambda block: _sketch(shingles(block.texts, n)[1], width), _add_sketches, "jaccard-sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            doc, h = shingles(block.texts, n)
            freq = _estimates(h, width, path, block)
            cuts = np.searchsorted(doc, np.arange(len(block.texts) + 1))
            rows, seen = [], set()
            for r, i, a, b in zip(block.column(ROW).to_pylist(), block.ids, cuts[:-1].tolist(), cuts[1:].tolist()):
                size = b - a
                if not size:
                    rows.append((r, i, 0, None, None, None, None, None))
                    continue
                own, f = h[a:b], freq[a:b]
                mark = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                prefix = place = often = shared = None
                common = np.flatnonzero(f > 1)
                alone, bound = size - len(common), size - (-(-num * size // den)) + 1
                if alone < bound and mark not in seen:
                    seen.add(mark)
                    order = common[np.lexsort((own[common], f[common]))][:bound - alone]
                    prefix, shared = own[order].tobytes(), own[common].tobytes()
                    place = np.arange(alone, alone + len(order), dtype=np.uint32).tobytes()
                    often = int(np.count_nonzero(f[order] >= min(255, longest + 1)))    # an estimate is never too low
                rows.append((r, i, size, mark, prefix, place, often, shared))
            for k in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k:k + 2000]), SETS.types)],
                                                 schema=SETS)

    return written(parts.mapInArrow(tidy(run), SETS_DDL), "jaccard-sets")


@dataclass
class Lists:
    """The posting lists that are cut, by shingle: classes, those that could reach the threshold
    with one of their own size from there, the largest component and its classes."""
    shingle: np.ndarray
    n: np.ndarray
    able: np.ndarray
    comp: np.ndarray
    same: np.ndarray

    def others(self) -> np.ndarray:
        return self.n - self.same

    def copies(self, longest: int) -> int:
        """Postings of the last round."""
        o, c = -(-self.others() // longest), -(-self.same // longest)
        return int(np.where(self.able > 0, self.others() * (o + c) + self.same * o, 0).sum())


def _posted(batch: pa.RecordBatch):
    """Shingles, places and class rows (sig, size, comp, alone) of a batch, and the class of each posting."""
    prefix = [np.frombuffer(x, np.uint64) for x in batch.column("prefix").to_pylist()]
    places = [np.frombuffer(x, np.uint32) for x in batch.column("place").to_pylist()]
    alone = np.array([p[0] for p in places], np.int64)
    table = np.column_stack([*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "n", "comp")), alone])
    of = np.repeat(np.arange(len(prefix)), np.fromiter(map(len, prefix), np.int64, len(prefix)))
    return np.concatenate(prefix), np.concatenate(places).astype(np.int64), table, of


def _able(size: np.ndarray, place: np.ndarray, num: int, den: int) -> np.ndarray:
    return needed(size, size, num, den) <= size - place


def _long_lists(classes: DataFrame, num: int, den: int, longest: int) -> Lists:
    """The lists of more than ``longest`` classes: at most one in ``longest`` postings, so the driver holds them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h, place, table, of = _posted(batch)
            rest = np.cumsum(np.bincount(of, minlength=len(table)))[of] - np.arange(len(of))    # 1 for the last
            at = np.flatnonzero(rest <= batch.column("often").to_numpy(zero_copy_only=False)[of])
            key, back = np.unique(np.column_stack([h[at].view(np.int64), table[of[at], 2]]), axis=0, return_inverse=True)
            able = np.bincount(back.ravel(), _able(table[of[at], 1], place[at], num, den), len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key[:, 0], key[:, 1], np.bincount(
                back.ravel(), minlength=len(key)), able)], names=["h", "comp", "n", "able"])

    found = (classes.filter(F.col("often") > 0).select("sig", "n", "comp", "prefix", "place", "often")
             .mapInArrow(tidy(count), "h long, comp long, n long, able long")
             .groupBy("h", "comp").agg(F.sum("n").alias("n"), F.sum("able").alias("able"))
             .groupBy("h").agg(F.sum("n").alias("n"), F.sum("able").alias("able"),
                               F.max(F.struct("n", "comp")).alias("most"))
             .filter(F.col("n") > longest).select("h", "n", "able", "most.comp", F.col("most.n").alias("same")).collect())
    rows = np.array([tuple(r) for r in found], np.int64).reshape(-1, 5)
    rows = rows[np.argsort(rows[:, 0].view(np.uint64))]
    return Lists(rows[:, 0].view(np.uint64), *rows[:, 1:].T)


def _key(sig: np.ndarray, round_: int | None) -> np.ndarray:
    """The order of classes in a round."""
    return mix(sig.view(np.uint64), round_) if round_ else sig.view(np.uint64)


def _dealt(h, of, table, lists: Lists, longest: int, round_: int | None):
    """(posting, group, side) a copy of a posting, in chunks; in a group the left (bit 1) meet the
    right (bit 2). A list that is not cut is a group, of both sides."""
    k = np.minimum(np.searchsorted(lists.shingle, h), max(0, len(lists.shingle) - 1))
    cut = lists.shingle[k] == h if len(lists.shingle) else np.zeros(len(h), bool)
    yield (at := np.flatnonzero(~cut)), h[at], np.full(len(at), 3, np.uint8)
    at = np.flatnonzero(cut)
    k = k[at]
    at, k = at[ok := lists.able[k] > 0], k[ok]
    sig, part = table[of[at], 0].copy(), np.uint64(32)
    if round_ is not None:
        block = (_key(sig, round_) >> part) * (-(-lists.n[k] // longest)).astype(np.uint64) >> part
        yield at, mix(h[at] ^ mix(block + np.uint64(1), 41), 42), np.full(len(at), 3, np.uint8)
        return
    # others (outside the largest component) in o blocks, the rest in c: pairs of two blocks of others,
    # and of one of each
    o, c = -(-lists.others()[k] // longest), -(-lists.same[k] // longest)
    other = table[of[at], 2] != lists.comp[k]
    own = ((mix(sig.view(np.uint64), 40) >> part) * np.where(other, o, c).astype(np.uint64) >> part).astype(np.int64)
    times = np.where(other, o + c, o)
    chunk = np.cumsum(times) // COPIES
    for _, x in _cut(chunk, 1):
        i = np.repeat(np.arange(len(at))[x], times[x])
        t = np.arange(len(i)) - np.repeat(np.cumsum(times[x]) - times[x], times[x])
        mate = t - c[i]                                           # another block of others, from 0 on
        left = np.where(other[i] & (mate >= 0), np.minimum(own[i], mate), np.where(other[i], own[i], t))
        right = np.where(other[i] & (mate >= 0), c[i] + np.maximum(own[i], mate), np.where(other[i], t, own[i]))
        side = np.where(~other[i], 2, np.where((mate < 0) | (mate > own[i]), 1, np.where(mate == own[i], 3, 2)))
        code = (left * (o + c)[i] + right).astype(np.uint64)
        yield at[i], mix(h[at[i]] ^ mix(code + np.uint64(1), 41), 42), side.astype(np.uint8)


def _candidates(h, of, place, side, classes, ranges, num, den, round_: int | None) -> np.ndarray:
    """Pairs (two columns) of one bucket that share a posted shingle, may reach the threshold and
    are in different components; with a round, only neighbours in that round's order. Postings
    are (group, class, place, side); classes have rows (sig, size, comp, alone) and range counts."""
    key = _key(classes[of, 0], round_)
    order = np.lexsort((key, classes[of, 1], h)) if round_ is None else np.lexsort((key, h))
    h, of, place, side = h[order], of[order], place[order], side[order]
    sig, size, comp, alone = (classes[of, k] for k in range(4))
    n, found = len(h), [np.zeros((0, 2), np.int64)]

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        a, b = size[i], size[j]
        need = needed(a, b, num, den)
        most = np.minimum(a - place[i], b - place[j])             # if this is the first shared shingle
        if round_ is not None:
            # shared shingles before this one are posted ones of both
            most += np.minimum(place[i] - alone[i], place[j] - alone[j])
        ok = (comp[i] != comp[j]) & (sig[i] != sig[j]) & (np.minimum(a, b) >= need) & (most >= need)
        i, j, need = i[ok], j[ok], need[ok]
        # suffix filter: what two sets share in each hash range is at most the smaller count (255: or more)
        for k in range(0, len(i), 8192):
            x, y = i[k:k + 8192], j[k:k + 8192]
            least = np.minimum(ranges[of[x]], ranges[of[y]])
            ok = (least.sum(axis=1, dtype=np.int64) >= need[k:k + 8192]) | (least == 255).any(axis=1)
            x, y = sig[x[ok]], sig[y[ok]]
            if len(x):
                found.append(np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)]), axis=0))

    if round_ is not None:
        for step in range(1, REACH + 1):
            i = np.flatnonzero(h[step:] == h[:-step]) if n > step else np.zeros(0, np.int64)
            keep(i, i + step)
    else:
        # sizes a class may meet, from this shingle on
        low, high = -(-num * size // den), (num + den) * (size - place) // num - size
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if n else np.zeros(0, np.int64)
        for a, b in zip(begin.tolist(), np.append(begin[1:], n).tolist()):
            if b - a < 2:
                continue
            kinds, back, count = np.unique(comp[a:b], return_inverse=True, return_counts=True)
            if len(kinds) < 2:
                continue
            if (side[a:b] == 3).all():
                # each member outside the largest component against all; the largest needs no own turn
                turn, mates = a + np.flatnonzero(back != count.argmax()), np.arange(a, b)
            else:
                turn, mates = a + np.flatnonzero(side[a:b] & 1), a + np.flatnonzero(side[a:b] & 2)
            first = np.searchsorted(size[mates], low[turn])
            times = np.maximum(0, np.searchsorted(size[mates], high[turn], side="right") - first)
            for _, x in _cut(np.cumsum(times) // COPIES, 1):
                i = np.repeat(turn[x], times[x])
                t = np.arange(len(i)) - np.repeat(np.cumsum(times[x]) - times[x], times[x])
                keep(i, mates[np.repeat(first[x], times[x]) + t])
                if len(found) > 500:
                    found = [np.unique(np.concatenate(found), axis=0)]
    return np.unique(np.concatenate(found), axis=0)


def _pairs(classes: DataFrame, num: int, den: int, round_: int | None, posted: int, longest: int) -> DataFrame:
    """Distinct candidate pairs (a, b) of class signatures from different components."""
    lists = _long_lists(classes, num, den, longest)
    buckets = max(1, (posted + (lists.copies(longest) if round_ is None else 0)) // POSTINGS)
    if round_ is None:
        # lists of one component have no copies
        lists.able[lists.others() == 0] = 0
    shared = classes.sparkSession.sparkContext.broadcast(lists)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h, place, table, of = _posted(batch)
            ranges = np.frombuffer(b"".join(batch.column("ranges").to_pylist()), np.uint8).reshape(-1, RANGES)
            for at, group, side in _dealt(h, of, table, shared.value, longest, round_):
                bucket = (mix(group, 20) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                for b, own in _cut(bucket[order], 1):
                    copy = order[own]
                    used, local = np.unique(of[at[copy]], return_inverse=True)    # each class once a row
                    values = (group[copy], local.astype(np.uint32), place[at[copy]].astype(np.uint32), side[copy],
                              table[used], ranges[used])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in values)],
                        names=["bucket", "h", "of", "place", "side", "classes", "ranges"])

    def meet(table: pa.Table) -> pa.Table:
        def all_(name: str, kind) -> list[np.ndarray]:
            return [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]

        known = [c.reshape(-1, 4) for c in all_("classes", np.int64)]
        before = np.cumsum([0, *map(len, known)])
        of = np.concatenate([x.astype(np.int64) + k for x, k in zip(all_("of", np.uint32), before)])
        pairs = _candidates(np.concatenate(all_("h", np.uint64)), of, np.concatenate(all_("place", np.uint32)).astype(np.int64),
                            np.concatenate(all_("side", np.uint8)), np.concatenate(known),
                            np.concatenate(all_("ranges", np.uint8)).reshape(-1, RANGES), num, den, round_)
        release()
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return (classes.select("sig", "n", "comp", "prefix", "place", "ranges")
            .mapInArrow(tidy(post), "bucket int, h binary, of binary, place binary, side binary, classes binary, ranges binary")
            .groupBy("bucket").applyInArrow(meet, "a long, b long").distinct())


def _links(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that reach the threshold, verified once on the sets."""
    sides = [classes.select(F.col("sig").alias(k), F.col("n").alias(f"n_{k}"), F.col("shared").alias(f"shared_{k}"))
             for k in ("a", "b")]

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            overlap = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                       for x, y in zip(batch.column("shared_a").to_pylist(), batch.column("shared_b").to_pylist())]
            need = needed(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b")), num, den)
            ok = pa.array(np.array(overlap, np.int64) >= need)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(tidy(verified), "a long, b long")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class number (as many different ones as rows), and counts of the shared shingles by hash range."""
    for batch in batches:
        sig = mix(batch.column("row").to_numpy(zero_copy_only=False).view(np.uint64), 30).view(np.int64)
        rows = [np.minimum(np.bincount((np.frombuffer(x, np.uint64) >> np.uint64(57)).astype(np.int64), minlength=RANGES), 255)
                .astype(np.uint8).tobytes() for x in batch.column("shared").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(sig), *batch.columns[1:], pa.array(rows, pa.binary())],
                                         names=["sig", *batch.schema.names[1:], "ranges"])


def _classes(rows: DataFrame) -> tuple[DataFrame, int]:
    """The classes that post shingles, written, and how many postings they have."""
    first = (rows.filter(F.col("prefix").isNotNull()).groupBy("mark")
             .agg(F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("n", "prefix", "place", "often", "shared")])
             .filter(F.octet_length("prefix") > 0)
             .select("row", "mark", "n", "prefix", "place", "often", "shared"))
    classes = written(first.mapInArrow(tidy(_ranges), "sig long, mark binary, n long, prefix binary, place binary, often long, "
                                                "shared binary, ranges binary"), "jaccard-classes")
    return classes, int(classes.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0)


def tagged(table: DataFrame, n: int, num: int, den: int, longest: int = LONGEST) -> DataFrame:
    """row, doc_id, n_shingles and class of every row of a numbered table: rows of one component
    share the class, rows without shingles have none."""
    rows = sets(table, n, num, den, longest)
    classes, posted = _classes(rows)
    labels = None
    for round_ in [*range(ROUNDS), None]:
        known = classes.withColumn("comp", F.col("sig"))
        if labels is not None:
            known = classes.join(labels, F.col("sig") == F.col("node"), "left").withColumn(
                "comp", F.coalesce("comp", "sig")).drop("node")
        pairs = written(_pairs(known, num, den, round_, posted, longest), "jaccard-pairs")
        links = _links(pairs, classes, num, den)
        if labels is not None:
            links = links.unionByName(labels.filter(F.col("node") != F.col("comp"))
                                      .select(F.col("node").alias("a"), F.col("comp").alias("b")))
        labels = written(components(links), "jaccard-labels")
    names = [classes.select(F.col("sig").alias(k), F.col("mark").alias(v)) for k, v in (("node", "mark"), ("comp", "own"))]
    linked = labels.join(names[0], "node").join(names[1], "comp").select("mark", "own")
    found = (rows.select("row", "doc_id", F.col("n").alias("n_shingles"), "mark").join(linked, "mark", "left")
             .select("row", "doc_id", "n_shingles", F.coalesce("own", "mark").alias("class")))
    return written(found, "jaccard-tagged")


def join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_shingles, component_id of every row (links: den * overlap >= num * union)."""
    found = tagged(numbered(id_text(docs)), n, num, den, longest)
    # written, so that the join has a shuffle of its own and a hot component can be split there
    least = written(found.filter(F.col("class").isNotNull()).groupBy("class")
                    .agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
                    .filter(F.col("rows") > 1).select("class", "least"), "jaccard-least")
    return (found.join(least, "class", "left")
            .select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")))


def links(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, longest: int = LONGEST) -> DataFrame:
    """Every link between different sets once, verified: a_id, b_id, the smallest doc_id of each set's
    rows (null if all are null), and n_a, n_b, how many rows have the set. All candidates are tried, also
    within a component, so a group of k linked sets may give k * (k - 1) / 2 rows."""
    rows = sets(numbered(id_text(docs)), n, num, den, longest)
    classes, posted = _classes(rows)
    pairs = written(_pairs(classes.withColumn("comp", F.col("sig")), num, den, None, posted, longest), "jaccard-pairs")
    least = (rows.filter(F.col("mark").isNotNull()).groupBy("mark").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"))
             .join(classes.select("sig", "mark"), "mark"))
    sides = [least.select(F.col("sig").alias(k), F.col("id").alias(f"{k}_id"), F.col("rows").alias(f"n_{k}")) for k in ("a", "b")]
    return (_links(pairs, classes, num, den).join(sides[0], "a").join(sides[1], "b")
            .select("a_id", "b_id", "n_a", "n_b"))


def representatives(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows that stay when one row of each component does: the smallest doc_id (null last),
    then the first row. Rows without shingles stay."""
    table = numbered(docs)
    found = tagged(table, n, num, den)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    stay = (found.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min(order)["row"].alias("row")).select("row")
            .unionByName(found.filter(F.col("class").isNull()).select("row")))
    key = table.columns[-1]
    return table.join(stay.withColumnRenamed("row", key), key, "left_semi").drop(key)
