"""N-gram Jaccard self-join of documents: a size-aware heavy-light join, and its groups.

Sets are the distinct 5-word shingles of whole texts, as 64-bit hashes.  Equal sets are one class, named by a hash of the set.
Two sets link when 100 * intersection >= 75 * union, so the intersection has at least 3/4 of the larger set.

- Light sets (at most `boundary` shingles): for each size c that the intersection with a partner can be held to, all subsets
  of c shingles are enumerated; linked light sets share one.
- Heavy sets: shingles are ordered by rarity, and the first n - ceil(3n/4) + 1 of them are posted to inverted lists with their
  place; linked sets share one, and at the first one that they share neither has its place too late for the intersection.
  Light sets large enough to link with a heavy one post theirs as well.

The boundary is the size with the least cost, by the numbers of sets of each size and the mean length of a list.  The order is
by exact counts of all shingles: those of the highest counts are known to all tasks (a bounded table: it only makes lists short,
any order gives the same links).

Lists are not expanded into all pairs.  In a round each list has up to PIVOTS pivots, the other sets are compared with these, and
the links' components are found; a list within one component is done.  Rounds go on while they do much; what is then left
of a list are sets that link with hardly any, and pairs of those across components are compared, in cells of a bounded part of
the list.  So a group of n near copies takes some n comparisons, and no link between different components is missed: linked sets
share a list, and either they are in one component already or the pair is compared.

Postings are packed by buckets of keys before they are shuffled, and lists are put together in arrays.  The list of a frequent shingle
is salted: its sets lie in many tasks, and only its few pivots are sent to them.  Keys of 32 bits and those of the bucket may be
alike by chance, which only adds candidates.

Pairs are compared in two steps.  A histogram of each set's hashes, of one byte for a bin, bounds the intersection from above;
whole sets are joined only to pairs that the bound lets pass.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, release, slices, small_batches, written
from .graph import connected_components
from .hashing import mix, span_hashes

WORDS, PART, WHOLE = 5, 75, 100
#: Shingles counted together in a task, and shingles of one bucket of the count, about.
POOL, BUCKET = 1_500_000, 500_000
#: Postings packed together in a task, and what is packed of one: the low bits of its key, its set, that set's size, its place there.
POSTINGS, POSTING = 400_000, np.dtype([("low", "<u4"), ("s", "<i8"), ("n", "<u4"), ("place", "<u4")])
SALTED_POSTING = np.dtype([("key", "<i8"), ("s", "<i8"), ("n", "<u4"), ("place", "<u4")])
#: Code points whose shingles are made at a time, and sets that a task remembers.
SLICE, REMEMBERED = 500_000, 100_000
#: Frequent shingles that order the lists: at least this count, and at most so many (16 bytes each, sent to all workers).
FREQUENT, MOST_FREQUENT = 6, 500_000
MOST_BOUNDARY = 12
#: Pivots of a list in a round; rounds go on while one closes this share of the open pairs, up to so many.
PIVOTS, MUCH, MOST_ROUNDS = 8, 0.5, 6
#: Sets of one cell of a list when all pairs are compared, about, and sets from which on a list is salted.
CELL, SALTED = 1_000, 4_000
#: Lists with more than this share of all rows (at most 1 / HOT_SHARE of them) have their pivots sent to all tasks.
HOT_SHARE = 1 / 20_000
#: Ids of candidates are sent to all workers up to this many (8 bytes each); beyond it texts are joined to them by a shuffle.
BROADCAST_IDS = 1_000_000
#: Shingles for each bin of a histogram, at most, and the least count of bins.
BIN_LOAD, LEAST_BINS = 2, 16

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MULT = np.random.default_rng(10).integers(1, 2**63, WORDS + 1, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The ascending shingle hashes (as int64) of each text."""
    raw = [t.encode() for t in texts]
    a = _LOW[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    space = _SPACE[a]
    start = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    end = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    words = span_hashes(a, start, end)
    edge = np.searchsorted(start, np.cumsum([0, *(len(x) + 1 for x in raw)])).tolist()
    n = max(0, len(words) - WORDS + 1)
    shingles = np.zeros(n, np.uint64)
    for k in range(WORDS):
        shingles += words[k : k + n] * _MULT[k]
    shingles = mix(shingles).view(np.int64)
    out = []
    for s, e in zip(edge, edge[1:]):
        if e - s >= WORDS:
            out.append(np.unique(shingles[s : e - WORDS + 1]))
        elif e > s:
            out.append(mix((words[s:e] * _MULT[: e - s]).sum(dtype=np.uint64, keepdims=True) + _MULT[WORDS:] * np.uint64(e - s)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def need(n: int) -> int:
    """Least intersection of a set of n shingles with any partner."""
    return -(-PART * n // WHOLE)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return WHOLE * both >= PART * (len(a) + len(b) - both) and both > 0


def histogram(x: np.ndarray) -> bytes:
    """Counts of hashes by their low bits; a power of two of bins.  Empty if a bin has more than a byte holds."""
    bins = max(LEAST_BINS, 1 << (max(1, len(x) // BIN_LOAD) - 1).bit_length())
    counts = np.bincount(x & (bins - 1), minlength=bins)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_link(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether histograms (uint8) leave it open that their sets link: bins hold at most the lesser count in common."""
    if not len(a) or not len(b):
        return True
    if len(a) > len(b):
        a, b = b, a
    a, b = a.astype(np.int64), b.reshape(-1, len(a)).sum(0, dtype=np.int64)
    most = int(np.minimum(a, b).sum())
    return WHOLE * most >= PART * (int(a.sum()) + int(b.sum()) - most)


def _set_id(x: np.ndarray) -> int:
    return int.from_bytes(blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(batch, texts: int):
    """The rows of a batch with their shingle sets, in slices of bounded length."""
    col = batch.column(texts).to_pylist()
    for s, e in slices([len(t or "") for t in col], SLICE):
        yield batch.slice(s, e - s), shingle_sets([t or "" for t in col[s:e]])


def _scan(src: DataFrame) -> DataFrame:
    """doc_id, text_hash, n, s (name of the set; null for an empty one) of every row."""

    def run(batches):
        for batch in batches:
            for rows, sets in _sets(batch, 2):
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array([_set_id(x) if len(x) else None for x in sets], pa.int64())], names=["doc_id", "text_hash", "n", "s"])

    return src.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n long, s long")


def _prints(x: np.ndarray, bits: int) -> np.ndarray:
    """The high 32 + bits bits of shingles: what they are counted by."""
    return (x.view(np.uint64) >> np.uint64(32 - bits)).view(np.int64)


def _counts(src: DataFrame, bits: int) -> DataFrame:
    """print, count of all shingles that occur in FREQUENT sets or more.

    Each task counts its own shingles first.  The high bits of a print are its bucket, the other 32 are packed; so few are alike by
    chance that the order hardly feels it."""

    def packed(pool: list[np.ndarray]):
        value, count = np.unique(_prints(np.concatenate(pool), bits), return_counts=True)
        edge = np.searchsorted(value, np.arange((1 << bits) + 1) << 32).tolist()
        low, one = value.astype(np.uint32), count == 1
        rows = []
        for b, (s, e) in enumerate(zip(edge, edge[1:])):
            if e > s:
                some = ~one[s:e]
                rows.append((b, low[s:e][~some].tobytes(), low[s:e][some].tobytes() + count[s:e][some].astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "ones", "more"])

    def run(batches):
        pool, size, seen = [], 0, set()
        for batch in batches:
            for _, sets in _sets(batch, 0):
                for x in sets:
                    if len(x) and (i := hash(x.tobytes())) not in seen:
                        seen.add(i)
                        pool.append(x)
                        size += len(x)
                if size >= POOL:
                    yield packed(pool)
                    pool, size, seen = [], 0, set()
        if pool:
            yield packed(pool)

    def merged(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        value, at = np.unique(np.concatenate(values), return_inverse=True)
        return value, np.bincount(at, np.concatenate(counts), len(value)).astype(np.int64)

    def add(batches):
        now, values, counts, size = None, [], [], 0

        def done():
            value, count = merged(values, counts)
            some = count >= FREQUENT
            return pa.RecordBatch.from_arrays([pa.array(value[some].astype(np.int64) | now << 32), pa.array(count[some])], names=["print", "count"])

        for batch in batches:
            for b, ones, more in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if b != now and values:
                    yield done()
                    values, counts, size = [], [], 0
                now = b
                x, y = np.frombuffer(ones.as_buffer(), np.uint32), np.frombuffer(more.as_buffer(), np.uint32)
                values += [x, y[: len(y) // 2]]
                counts += [np.ones(len(x)), y[len(y) // 2 :]]
                size += len(x) + len(y)
                if size > 8 * BUCKET:
                    value, count = merged(values, counts)
                    values, counts, size = [value], [count], 0
        if values:
            yield done()

    made = src.select("text").mapInArrow(run, "bucket int, ones binary, more binary")
    return made.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "print long, count long")


def frequent_shingles(src: DataFrame, total: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Bits of the buckets; prints of the highest counts, ascending, and their counts; at most MOST_FREQUENT."""
    bits = min(31, max(0, (max(1, total // BUCKET) - 1).bit_length()))
    counts = written(_counts(src, bits), "counts")
    level = F.floor(F.log2("count") * 4).cast("int")
    least, sum_ = None, 0
    for r in sorted(counts.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect(), reverse=True):
        sum_ += r["n"]
        if sum_ > MOST_FREQUENT:
            break
        least = r["l"]
    got = counts.where(level >= least).toPandas() if least is not None else None
    drop_written(counts)
    if got is None:
        return bits, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(got["print"].to_numpy())
    return bits, got["print"].to_numpy()[order], got["count"].to_numpy()[order]


def subsets_of(n: int) -> int:
    return sum(comb(n, c) for c in range(need(n), n + 1))


def choose_boundary(sizes: dict[int, int], list_length: float) -> int:
    """The largest size of light sets with the least cost: rows that light sets enumerate, and rows that other sets post, each
    with the list that it meets."""

    def cost(x: int) -> float:
        total = 0.0
        for n, sets in sizes.items():
            posted = (n - need(n) + 1) * (1 + list_length)
            total += sets * ((subsets_of(n) if n <= x else 0) + (posted if n > x or n >= need(x + 1) and x else 0))
        return total

    return min(range(MOST_BOUNDARY + 1), key=lambda x: (cost(x), x))


class Lister:
    """What sets are listed under."""

    def __init__(self, boundary: int, bits: int, prints: np.ndarray, counts: np.ndarray):
        self.boundary, self.bits, self.prints, self.counts = boundary, bits, prints, counts
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[prints & (len(self.maybe) - 1)] = True
        self.combos: dict = {}

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, place in the set's order, and number of the key's sets where it is frequent (else 0)."""
        n, key, place, count = len(x), [], [], []
        if n <= self.boundary:
            mixed = mix(x.view(np.uint64))
            for c in range(need(n), n + 1):
                if (n, c) not in self.combos:
                    self.combos[n, c] = np.array(list(combinations(range(n), c)))
                key.append(mix(mixed[self.combos[n, c]].sum(axis=1, dtype=np.uint64) + _MULT[:1] * np.uint64(c)).view(np.int64))
                place.append(np.zeros(len(key[-1]), np.int32))
                count.append(place[-1])
        if n > self.boundary or n >= need(self.boundary + 1):
            k = n - need(n) + 1
            p = _prints(x, self.bits)
            hot = np.flatnonzero(self.maybe[p & (len(self.maybe) - 1)]) if len(self.prints) else np.zeros(0, np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(self.prints, p[hot]), len(self.prints) - 1)
                true = self.prints[at] == p[hot]
                hot, at = hot[true], at[true]
            rest = np.delete(x, hot)[:k] if len(hot) else x[:k]
            key.append(rest)
            count.append(np.zeros(len(rest), np.int32))
            if len(rest) < k:
                often = self.counts[at]
                last = np.lexsort((x[hot], often))[: k - len(rest)]
                key.append(x[hot[last]])
                count.append(often[last].astype(np.int32))
            place.append(np.arange(k, dtype=np.int32))
        return np.concatenate(key), np.concatenate(place), np.concatenate(count)


def _postings(src: DataFrame, boundary: int, bits: int, shared) -> DataFrame:
    """bucket, salted, packed: the postings of every set; sets that a task saw before are left out.

    A bucket takes the keys with the same high bits, so that a list is in one bucket; a salted list, which holds more than one set
    anyway, is dealt to buckets by its sets, so that copies meet there."""
    def packed(parts: list[tuple]):
        key, often, s, n, place = (np.concatenate(c) for c in zip(*parts))
        rows, plain = [], ~often
        prints = _prints(key[plain], bits)
        order = np.argsort(prints >> 32, kind="stable")
        bucket = (prints >> 32)[order]
        post = np.zeros(len(order), POSTING)
        post["low"], post["s"], post["n"], post["place"] = (prints & 0xFFFFFFFF)[order], s[plain][order], n[plain][order], place[plain][order]
        edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else [0]
        rows += [(int(bucket[x]), False, post[x:y].tobytes()) for x, y in zip(edge, edge[1:])]
        some = np.flatnonzero(often)
        some = some[np.argsort(s[some] & (1 << bits) - 1, kind="stable")]
        bucket = s[some] & (1 << bits) - 1
        post = np.zeros(len(some), SALTED_POSTING)
        post["key"], post["s"], post["n"], post["place"] = key[some], s[some], n[some], place[some]
        edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else [0]
        rows += [(int(bucket[x]), True, post[x:y].tobytes()) for x, y in zip(edge, edge[1:])]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary()))], names=["bucket", "salted", "packed"])

    def run(batches):
        lister, seen, parts, size = Lister(boundary, *shared.value), set(), [], 0
        for batch in batches:
            for _, sets in _sets(batch, 0):
                for x in sets:
                    if not len(x) or (i := _set_id(x)) in seen:
                        continue
                    if len(seen) < REMEMBERED:
                        seen.add(i)
                    key, place, count = lister.keys(x)
                    parts.append((key, count > SALTED, np.full(len(key), i), np.full(len(key), len(x), np.uint32), place.astype(np.uint32)))
                    size += len(key)
                if size >= POSTINGS:
                    yield packed(parts)
                    parts, size = [], 0
        if parts:
            yield packed(parts)

    return src.select("text").mapInArrow(run, "bucket int, salted boolean, packed binary")


def _lists(postings: DataFrame) -> DataFrame:
    """key, s, n, place of the sets of lists that have another set of a fitting size in their list (any, in a salted list)."""

    def of(key, post: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(post["s"]), pa.array(post["n"].astype(np.int32)), pa.array(post["place"].astype(np.int32))], names=["key", "s", "n", "place"])

    def met(bucket: int, parts: list[bytes]):
        post = np.frombuffer(b"".join(parts), POSTING)
        post = post[np.lexsort((post["s"], post["n"], post["low"]))]
        again = (post["low"][1:] == post["low"][:-1]) & (post["s"][1:] == post["s"][:-1])
        post = post[np.concatenate(([True], ~again))]
        n = post["n"].astype(np.int64)
        near = (post["low"][1:] == post["low"][:-1]) & (WHOLE * n[:-1] >= PART * n[1:])
        post = post[np.concatenate(([False], near)) | np.concatenate((near, [False]))]
        return of(post["low"].astype(np.int64) | bucket << 32, post)

    def once(parts: list[bytes]):
        post = np.frombuffer(b"".join(parts), SALTED_POSTING)
        _, first = np.unique(post[["key", "s"]], return_index=True)
        return of(post["key"][first], post[first])

    def run(batches):
        now, parts, salted = None, [], []
        for batch in batches:
            for bucket, often, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if bucket != now:
                    if parts:
                        yield met(now, parts)
                    if salted:
                        yield once(salted)
                    now, parts, salted = bucket, [], []
                (salted if often else parts).append(packed.as_py())
        if parts:
            yield met(now, parts)
        if salted:
            yield once(salted)

    dealt = postings.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "key long, s long, n int, place int")


def _may_meet(x: str, y: str):
    """Whether two sets (n, place of a shared shingle) can link, if it is the first one that they share."""
    n = F.col(f"{x}n") + F.col(f"{y}n")
    left = F.least(F.col(f"{x}n") - F.col(f"{x}place"), F.col(f"{y}n") - F.col(f"{y}place"))
    return left * (PART + WHOLE) >= n * PART


def _values(src: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """s, bins, shingles (binary) of the sets in pairs, from the texts of their classes' least doc_ids."""
    ids = pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).distinct().join(classes.select("s", F.col("rep").alias("doc_id")), "s")
    ids = written(ids.select("doc_id").distinct(), "ids")
    rows = src.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")

    def run(batches):
        for batch in batches:
            for _, sets in _sets(batch, 0):
                some = [x for x in sets if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([_set_id(x) for x in some], pa.int64()), pa.array([histogram(x) for x in some], pa.binary()), pa.array([x.tobytes() for x in some], pa.binary())], names=["s", "bins", "shingles"])

    out = written(rows.select("text").mapInArrow(run, "s long, bins binary, shingles binary"), "values")
    drop_written(ids)
    return out


def _passing(pairs: DataFrame, values: DataFrame, column: str, test, dtype) -> DataFrame:
    """The pairs (a, b) of which test(value of a, value of b) holds."""
    side = lambda s, v: values.select(F.col("s").alias(s), F.col(column).alias(v))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            ok = [test(np.frombuffer(p.as_buffer(), dtype), np.frombuffer(q.as_buffer(), dtype)) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, classes: DataFrame, src: DataFrame) -> DataFrame:
    """The written pairs (a, b) whose sets link, as (u, v): by the bound of histograms, then by whole sets."""
    values = _values(src, classes, pairs)
    open_pairs = written(_passing(pairs, values, "bins", may_link, np.uint8), "passing")
    links = written(_passing(open_pairs, values, "shingles", linked, np.int64), "verified")
    drop_written(open_pairs)
    drop_written(values)
    return links.toDF("u", "v")


def _pivot_pairs(open_: DataFrame, step: int) -> DataFrame:
    """a, b: sets of each list with its pivots: of those in its largest component (top), or of all, the sets of least hash in each of
    PIVOTS classes."""
    turn = F.xxhash64("s", F.lit(step))
    size = open_.groupBy("key").agg(F.count("*").alias("size"))
    top = (open_.where("comp = top") if "top" in open_.columns else open_).groupBy("key", F.pmod(turn, F.lit(PIVOTS)).alias("class")).agg(F.min(F.struct(turn.alias("t"), "s", "n", "place", "comp")).alias("p"))
    pivots = written(top.select("key", *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("s", "n", "place", "comp")]), "pivots")
    least = (F.col("size") > F.lit(max(1000.0, HOT_SHARE * open_.count())))
    hot = written(size.where(least).select("key"), "hot")
    met = lambda d, p: d.join(p, "key").where((F.col("comp") != F.col("p_comp")) & _may_meet("", "p_")).select(F.least("s", "p_s").alias("a"), F.greatest("s", "p_s").alias("b"))
    few = F.broadcast(hot)
    of_hot = met(open_, F.broadcast(pivots.join(few, "key", "left_semi")))
    of_cold = met(open_.join(few, "key", "left_anti"), pivots.join(few, "key", "left_anti"))
    out = written(of_hot.unionByName(of_cold).distinct(), "pairs")
    for d in (pivots, hot):
        drop_written(d)
    return out


def _all_pairs(open_: DataFrame) -> DataFrame:
    """a, b: pairs of sets of a list in different components.  A long list is dealt to parts; each cell has two parts of it."""
    size = open_.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > CELL).select("key", F.ceil(F.col("m") / CELL).cast("int").alias("parts"))
    rows = open_.join(size, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("s"), F.col("parts")).cast("int")
    rows = rows.withColumn("part", part)
    # part p meets part q >= p in cell (p, q)
    every = lambda: F.sequence(F.lit(0), F.col("parts") - 1)
    cells = rows.withColumn("other", F.explode(every())).select("key", "s", "n", "place", "comp", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    x, y = (cells.select("key", "p", "q", *[F.col(c).alias(f"{t}_{c}") for c in ("s", "n", "place", "comp", "part")]) for t in "xy")
    fits = (F.col("x_comp") < F.col("y_comp")) & _may_meet("x_", "y_") & ((F.col("p") == F.col("q")) | (F.col("x_part") != F.col("y_part")))
    turned = F.col("x_s") > F.col("y_s")
    side = lambda c: [F.when(turned, F.col(f"y_{c}")).otherwise(F.col(f"x_{c}")), F.when(turned, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}"))]
    got = x.join(y, ["key", "p", "q"]).where(fits).select(*[v.alias(f"{t}{c}") for c in ("s", "n", "place") for t, v in zip("ab", side(c))])
    # the shared shingles that pass are the first that both have: behind the last of them lies what more they may share
    met = got.groupBy(F.col("as").alias("a"), F.col("bs").alias("b"), "an", "bn").agg(F.count("*").alias("m"), F.max("aplace").alias("ap"), F.max("bplace").alias("bp"))
    most = F.col("m") + F.least(F.col("an") - F.col("ap"), F.col("bn") - F.col("bp")) - 1
    return written(met.where(most * (PART + WHOLE) >= (F.col("an") + F.col("bn")) * PART).select("a", "b"), "pairs")


def _links(lists: DataFrame, classes: DataFrame, src: DataFrame) -> DataFrame:
    """Links (u, v) that join the same components as all links."""
    open_ = lists.withColumn("comp", F.col("s"))
    found: list[DataFrame] = []
    before = None
    for step in range(MOST_ROUNDS + 1):
        if not step:
            pairs = _pivot_pairs(open_, step)
            found.append(verified(pairs, classes, src))
            drop_written(pairs)
            open_ = _in_components(open_, found)
            release(open_.sparkSession)
            continue
        own = open_.groupBy("key", "comp").agg(F.count("*").cast("double").alias("k"))
        left = own.groupBy("key").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("cross"), F.max(F.struct("k", "comp"))["comp"].alias("top")).where("cross > 0")
        keys = written(left, "keys")
        cross = keys.agg(F.sum("cross")).first()[0] or 0.0
        if not cross:
            drop_written(keys)
            break
        last = step == MOST_ROUNDS or before is not None and cross > (1 - MUCH) * before
        now = written(open_.join(keys.select("key", "top"), "key"), "open")
        pairs = _all_pairs(now) if last else _pivot_pairs(now, step)
        new = verified(pairs, classes, src)
        found.append(new)
        for d in (pairs, keys, open_):
            drop_written(d)
        if last:
            drop_written(now)
            break
        open_ = _in_components(now, found)
        drop_written(now)
        release(open_.sparkSession)
        before = cross
    return _union(found) if found else lists.sparkSession.createDataFrame([], "u long, v long")


def _in_components(open_: DataFrame, found: list[DataFrame]) -> DataFrame:
    """The written rows of lists with the component of each set by the links found."""
    comps = connected_components(_union(found))
    out = written(open_.drop("comp", "top").join(comps.withColumnRenamed("node", "s"), "s", "left").select("key", "s", "n", "place", F.coalesce("component", "s").alias("comp")), "open")
    drop_written(comps)
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (xxhash64), n_shingles, class_id (least doc_id with an equal set), component_id (least doc_id reachable by
    links), group_id (a name of the component; null without words) of every row of docs (doc_id, text).

    Texts that are null or have no word have no shingle: class_id and component_id are their own doc_id, and they link with
    nothing.  Repeated rows stay as they are, and rows of one doc_id with different texts are different documents; a row without a
    doc_id takes the ids of its class, if that has any, and names none.  Long texts are whole; ties do not matter, as ids are
    minima; other columns take no part, whatever their names; an empty table gives no rows."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(_scan(src), "scanned")
    classes = written(rows.where("n > 0 and doc_id is not null").groupBy("s").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "classes")
    sizes = {r["n"]: r["k"] for r in classes.where(F.col("n") <= 2 * MOST_BOUNDARY).groupBy("n").agg(F.count("*").alias("k")).collect()}
    total = rows.agg(F.sum("n")).first()[0] or 0
    bits, prints, counts = frequent_shingles(src, total)
    boundary = choose_boundary(sizes, 1 + float((counts.astype(float) ** 2).sum()) / max(1, total))
    shared = spark.sparkContext.broadcast((bits, prints, counts))
    lists = written(_lists(_postings(src, boundary, bits, shared)), "lists")
    shared.destroy()
    release(spark)
    links = _links(lists, classes, src)
    drop_written(lists)
    release(spark)
    comps = connected_components(links)
    label = classes.join(comps.withColumnRenamed("node", "s"), "s").groupBy("component").agg(F.min("rep").alias("least"))
    named = comps.join(label, "component").select(F.col("node").alias("s"), "least", F.col("component").alias("g"))
    of_class = written(classes.join(named, "s", "left").select("s", "rep", F.coalesce("least", "rep").alias("component"), "g"), "named")
    for d in (classes, comps):
        drop_written(d)
    return rows.join(of_class, "s", "left").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("g", "s").alias("group_id"))


def op9_components(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
