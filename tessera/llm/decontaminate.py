"""Benchmark decontamination by template canonicalisation.

Texts become template tokens: lower-case words, with a typed placeholder for each number, name (a capitalised word inside a
sentence; several in a row are one) and unit.  Windows of WINDOW template tokens of the documents are hash-joined to those of the
benchmark.  For each document and item that share windows, the values in the slots are compared along each alignment: one value
of the item must stand for one value of the document throughout, and differ from its other values (slot consistency).  A document
is contaminated by an item when consistent windows cover at least COVER of the item's windows, so re-parameterised questions
are found as well as copies, or when RUN tokens of the item follow each other word for word.  An item of fewer than LEAST_TOKENS
tokens is too short for a template: it is found word for word, where it is a sentence or line of its own.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches
from .hashing import span_hashes

WINDOW, COVER = 8, 0.5
#: Shortest item that is looked for by its template, in tokens; and the length of a quotation that counts whatever its share.
LEAST_TOKENS, RUN = 5, 13
#: Benchmarks with at most this many windows (about 100 bytes each) and bytes of text are sent to all workers; larger ones are joined
#: by a shuffle, with the same results.
BROADCAST_WINDOWS, BROADCAST_BYTES = 200_000, 16_000_000

# Words for numbers, and units.
NUMERALS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half third quarter double twice triple".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers g kg mg gram grams kilogram kilograms pound pounds lb lbs ounce ounces oz ton tons second seconds minute minutes min hour hours hr hrs day days week weeks month months year years cent cents dollar dollars euro euros usd eur percent liter liters litre litres ml l gallon gallons degree degrees celsius fahrenheit kelvin mph kph watt watts volt volts joule joules newton newtons hz khz mhz ghz kb mb gb tb".split()

WORD_KIND, NUM, NAME, UNIT = range(4)
_CLASS = np.zeros(256, np.uint8)  # 1 letter, 2 digit
for _c in [*range(65, 91), *range(97, 123), *range(128, 256)]:
    _CLASS[_c] = 1
_CLASS[48:58] = 2
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_STOP = np.zeros(256, np.int64)
_STOP[[10, 33, 46, 58, 63]] = 1
_MULT = np.random.default_rng(7).integers(1, 2**63, WINDOW + 1, np.uint64) * np.uint64(2) + np.uint64(1)
_SLOT = np.array([0, 11, 13, 17], np.uint64)
_fixed: tuple[np.ndarray, np.ndarray] | None = None


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[str]) -> np.ndarray:
    a = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words])
    return span_hashes(a, ends - [len(w) + 1 for w in words], ends - 1)


def _window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(tokens) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += tokens[k : k + n] * _MULT[k]
    return _mix(out + np.uint64(width) * _MULT[WINDOW:]).view(np.int64)


class Tokens:
    """Template tokens of some texts: hash, kind, hash of the value, start and end (bytes in the joined texts), whether a sentence
    begins, and the first token of each text."""

    def __init__(self, texts: list[str]):
        global _fixed
        if _fixed is None:
            _fixed = (np.sort(_word_hashes(NUMERALS)), np.sort(_word_hashes(UNITS)))
        raw = [t.encode() for t in texts]
        a = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        cls = _CLASS[a]
        inner = (a[1:-1] == 46) | (a[1:-1] == 44)  # a point or comma between digits belongs to the number
        point = np.flatnonzero(inner & (cls[:-2] == 2) & (cls[2:] == 2)) + 1
        word = cls > 0
        word[point] = True
        low = _LOW[a]
        lead = np.flatnonzero((a[:-1] == 0xC3) & (a[1:] >= 0x80) & (a[1:] <= 0x9E) & (a[1:] != 0x97))
        low[lead + 1] += 32
        before = np.concatenate(([False], word[:-1]))
        start, end = np.flatnonzero(word & ~before), np.flatnonzero(~word & before)
        value = span_hashes(low, start, end)
        kind = np.zeros(len(start), np.uint8)
        kind[cls[start] == 2] = NUM
        stops = np.concatenate(([0], np.cumsum(_STOP[a])))
        gap = np.concatenate(([0], end[:-1])) if len(end) else end
        first = stops[start] > stops[gap]
        if len(first):
            first[0] = True
        upper = (a[start] >= 65) & (a[start] <= 90)
        upper[np.isin(start, lead)] = True
        kind[upper & ~first & (end - start > 1)] = NAME
        for k, table in ((NUM, _fixed[0]), (UNIT, _fixed[1])):
            at = np.minimum(np.searchsorted(table, value), len(table) - 1)
            kind[(table[at] == value) & (kind == WORD_KIND)] = k
        keep = np.ones(len(kind), bool)
        keep[1:] = ~((kind[1:] == NAME) & (kind[:-1] == NAME) & ~first[1:])
        self.kind, self.value, self.start, self.end, self.first = kind[keep], value[keep], start[keep], end[keep], first[keep]
        self.hash = np.where(self.kind == WORD_KIND, self.value, _SLOT[self.kind])
        self.edge = np.searchsorted(self.start, np.cumsum([0, *(len(x) + 1 for x in raw)]))
        self.offset = np.cumsum([0, *(len(x) + 1 for x in raw)])
        self.raw = raw

    def windows(self, width: int = WINDOW) -> np.ndarray:
        """Hash of the window at each token, across texts too: of templates, or of values if it is too short for these."""
        return _window_hashes(self.hash if width >= LEAST_TOKENS else self.value, width)


def item_windows(texts: list[str]) -> list[np.ndarray]:
    """Window hashes of each item; an item of up to WINDOW tokens is one window of its length."""
    out = []
    for text in texts:
        t = Tokens([text])
        n = len(t.hash)
        out.append(t.windows(min(WINDOW, n)) if n else np.zeros(0, np.int64))
    return out


def match(doc: "Tokens", s: int, e: int, item: "Tokens") -> tuple[float, bool, int, int] | None:
    """Share of an item's windows found with consistent slots among the document's tokens s to e, whether all slot values are
    equal, and the first and last matching token; None if below COVER and without a quotation of RUN tokens."""
    width = min(WINDOW, len(item.hash))
    if width < LEAST_TOKENS:
        for i in range(s, e - width + 1):
            alone = (i == s or doc.first[i]) and (i + width == e or doc.first[i + width])
            if alone and (doc.value[i : i + width] == item.value).all():
                return 1.0, True, i, i + width - 1
        return None
    theirs: dict[int, list[int]] = defaultdict(list)
    for j, h in enumerate(item.windows(width).tolist()):
        theirs[h].append(j)
    n = sum(map(len, theirs.values()))
    hashes = _window_hashes(doc.hash[s:e], width)
    hit = np.flatnonzero(np.isin(hashes, np.fromiter(theirs, np.int64, len(theirs))))
    lines: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i in hit.tolist():
        for j in theirs[int(hashes[i])]:
            lines[(i - j) // 4].append((i, j))  # a few inserted or dropped tokens stay on one line
    covered, same, low, high, longest = set(), True, e, s, 0
    for pairs in lines.values():
        forth, back, good = {}, {}, []
        runs: dict[tuple[int, int], int] = {}  # tokens word for word that end with the window (i, j)
        for i, j in pairs:
            ok = True
            new = []
            for d in range(width):
                kind = item.kind[j + d]
                if kind in (NUM, NAME):
                    x, y = (kind, int(item.value[j + d])), (kind, int(doc.value[s + i + d]))
                    if forth.get(x, y) != y or back.get(y, x) != x:
                        ok = False
                        break
                    new.append((x, y))
            if ok:
                for x, y in new:
                    forth[x], back[y] = y, x
                    same = same and x == y
                good.append((i, j))
                if all(x == y for x, y in new):
                    runs[i, j] = runs.get((i - 1, j - 1), width - 1) + 1
                    longest = max(longest, runs[i, j])
        for i, j in good:
            covered.add(j)
            low, high = min(low, s + i), max(high, s + i + width - 1)
    cover = len(covered) / n if n else 0.0
    return (cover, same, low, high) if cover >= COVER or longest >= RUN else None


FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("same_values", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())])
FOUND_DDL = "doc_id long, item_id long, coverage double, same_values boolean, start long, end long"


def _row(doc_id, item_id, got, doc: Tokens, i: int) -> dict:
    """Start and end in code points of the text."""
    cover, same, low, high = got
    raw, at = doc.raw[i], doc.offset[i]
    s = len(raw[: doc.start[low] - at].decode())
    return {"doc_id": doc_id, "item_id": item_id, "coverage": cover, "same_values": same, "start": s, "end": s + len(raw[doc.start[low] - at : doc.end[high] - at].decode())}


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, coverage, same_values, start, end: one row for each document (doc_id, text) and item (item_id, text) that
    contaminates it.

    Null texts and items without a token match nothing; null doc_ids and item_ids stay null in the results; repeated documents give
    repeated results and repeated items count once; of several matches in a document their union's first and last token are given;
    texts are whole; other columns take no part, whatever their names; empty tables give no rows."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct().withColumn("item", F.xxhash64("item_id", "text"))

    def listed(batches):
        for batch in batches:
            wins = item_windows(batch.column(1).to_pylist())
            n = [len(w) for w in wins]
            owner = batch.column(2).take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([owner, pa.array(np.concatenate([*wins, np.zeros(0, np.int64)]))], names=["item", "w"])

    windows = items.mapInArrow(listed, "item long, w long").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > BROADCAST_BYTES or windows.limit(BROADCAST_WINDOWS + 1).count() > BROADCAST_WINDOWS:
        return _shuffled(src, items, windows)
    shared = spark.sparkContext.broadcast([tuple(r) for r in items.select("item_id", "text").collect()])

    def run(batches):
        rows = shared.value
        toks = [Tokens([t]) for _, t in rows]
        of: dict[int, set[int]] = defaultdict(set)
        short = set()
        for k, t in enumerate(toks):
            width = min(WINDOW, len(t.hash))
            if width:
                short |= {width} - {WINDOW}
                for h in t.windows(width).tolist():
                    of[h].add(k)
        known = np.sort(np.fromiter(of, np.int64, len(of)))
        maybe = np.zeros(1 << 20, bool)
        maybe[known & (len(maybe) - 1)] = True
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s, e in slices(list(map(len, texts)), 1_000_000):
                doc = Tokens(texts[s:e])
                pairs: set[tuple[int, int]] = set()
                for width in (WINDOW, *short) if len(known) else ():
                    w = doc.windows(width)
                    at = np.flatnonzero(maybe[w & (len(maybe) - 1)])
                    at = at[known[np.minimum(np.searchsorted(known, w[at]), len(known) - 1)] == w[at]]
                    owner = np.searchsorted(doc.edge, at, side="right") - 1
                    pairs |= {(o, k) for o, h in zip(owner.tolist(), w[at].tolist()) for k in of[h]}
                found = []
                for i, k in sorted(pairs):
                    got = match(doc, int(doc.edge[i]), int(doc.edge[i + 1]), toks[k])
                    if got:
                        found.append(_row(ids[s + i], rows[k][0], got, doc, i))
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=FOUND)

    return src.mapInArrow(run, FOUND_DDL)


def _shuffled(src: DataFrame, items: DataFrame, windows: DataFrame) -> DataFrame:
    """The same with windows of both sides joined by a shuffle, for a benchmark that is not sent to all workers.

    Rows are named by a hash of id and text, as ids may be null or repeat; equal rows are compared once and counted."""
    src = src.groupBy("doc_id", "text").agg(F.count("*").alias("times")).withColumn("row", F.xxhash64("doc_id", "text"))
    widths = [r[0] for r in _item_widths(items).collect()]

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            texts = batch.column(1).to_pylist()
            for s, e in slices(list(map(len, texts)), 1_000_000):
                doc = Tokens(texts[s:e])
                for width in widths:
                    w = doc.windows(width)
                    owner = np.searchsorted(doc.edge, np.arange(len(w)), side="right") - 1
                    yield pa.RecordBatch.from_arrays([ids.slice(s, e - s).take(pa.array(owner)), pa.array(w)], names=["row", "w"])

    pairs = src.select("row", "text").mapInArrow(run, "row long, w long").distinct().join(windows, "w").select("row", "item").distinct()
    both = src.join(pairs, "row").join(items.withColumnRenamed("text", "item_text"), "item").select("doc_id", "text", "item_id", "item_text", "times")

    def verify(batches):
        for batch in batches:
            for d, t, k, x, times in zip(*(c.to_pylist() for c in batch.columns)):
                doc = Tokens([t])
                got = match(doc, 0, len(doc.hash), Tokens([x]))
                if got:
                    yield pa.RecordBatch.from_pylist([_row(d, k, got, doc, 0)] * times, schema=FOUND)

    return both.mapInArrow(verify, FOUND_DDL)


def _item_widths(items: DataFrame) -> DataFrame:
    """The window widths in use: WINDOW, and the lengths of shorter items (fewer than WINDOW values)."""

    def run(batches):
        for batch in batches:
            n = {min(WINDOW, len(Tokens([t]).hash)) for t in batch.column(1).to_pylist()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(x for x in n if x), pa.int64())], names=["w"])

    return items.mapInArrow(run, "w long").distinct()


def op6_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All rows of find_contamination, which says what nulls, ties, repeated rows and the like give."""
    return find_contamination(docs, benchmark)
