"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can be inside no merge, so it is a certain cut: the fragments between
such pairs are encoded independently and their ids concatenated.  Pieces (the pre-tokenizer's words) repeat, so each worker
keeps a bounded table of the ids of recent pieces, found by hash and compared by their bytes; only the fragments of new pieces
run merges, all of one length together in NumPy matrices.

Words of Latin-1 characters are cut into pieces on arrays of code points, which is equivalent for them: they are in normal
form C, their lower case is one character, and their classes are fixed.  Words with other characters go through the tokenizer
file's own normalizer and pre-tokenizer.  White space delimits words (the tokenizer's pattern never spans it).
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches
from .hashing import same_spans, span_hashes

#: Pieces whose ids a worker keeps; beyond it the table starts anew.
CACHE_PIECES = 500_000
#: Code points worked on at a time; longer texts are cut at white space.
SLICE = 1_000_000
#: Pieces that the library encodes at a time.
LIBRARY_BATCH = 1_000
#: Fragments longer than this run merges from a heap, not in a matrix.
MATRIX_LEN = 64
NONE = np.int32(2**31 - 1)


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


# Character classes of Latin-1 for the pattern  's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+
SPACE, LETTER, NUMBER, OTHER, ODD = range(5)
WIDE_SPACES = [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _latin_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of the 256 characters."""
    cls, low = np.full(256, OTHER, np.uint8), np.arange(256, dtype=np.uint8)
    for c in range(256):
        ch, kind = chr(c), unicodedata.category(chr(c))[0]
        if c in (*range(9, 14), 32, 0x85, 0xA0):
            cls[c] = SPACE
        elif kind in "LN":
            cls[c] = LETTER if kind == "L" else NUMBER
        low[c] = ord(ch.lower())
    return cls, low


class IdTable:
    """Ids and bytes of pieces by their hash: open addressing over arrays, for whole batches of keys."""

    def __init__(self, bits: int = 20):
        self.mask = np.uint64((1 << bits) - 1)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.slots = np.zeros(int(self.mask) + 1, np.int32)
        self.n, self.used = 0, 0
        self.start, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.pool = np.zeros(4096, np.uint32)
        self.text, self.filled = np.zeros(4096, np.uint8), 0
        self.begin, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it is not there."""
        at = keys & self.mask
        seen = self.keys[at]
        out = np.where(seen == keys, self.slots[at], np.int32(-1))
        todo = np.flatnonzero((seen != keys) & (seen != 0))
        while len(todo):
            at = (at[todo] if len(at) != len(todo) else at) + np.uint64(1) & self.mask
            seen = self.keys[at]
            hit = seen == keys[todo]
            out[todo[hit]] = self.slots[at[hit]]
            more = ~hit & (seen != 0)
            todo, at = todo[more], at[more]
        return out

    def store(self, text: np.ndarray, size: np.ndarray, count: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Slots of pieces (their bytes end to end, and sizes) with the number of their ids and all ids in order."""
        k = len(size)
        while self.n + k > len(self.start):
            self.start, self.count, self.begin, self.size = (np.concatenate([x, x]) for x in (self.start, self.count, self.begin, self.size))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool])
        while self.filled + len(text) > len(self.text):
            self.text = np.concatenate([self.text, self.text])
        slots = np.arange(self.n, self.n + k, dtype=np.int32)
        self.count[slots], self.size[slots] = count, size
        self.start[slots] = self.used + np.cumsum(count) - count
        self.begin[slots] = self.filled + np.cumsum(size) - size
        self.pool[self.used : self.used + len(ids)] = ids
        self.text[self.filled : self.filled + len(text)] = text
        self.n, self.used, self.filled = self.n + k, self.used + len(ids), self.filled + len(text)
        return slots

    def add(self, keys: np.ndarray, slots: np.ndarray) -> None:
        """Make stored pieces known by new, different keys."""
        at, todo = keys & self.mask, np.arange(len(keys))
        while len(todo):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[todo[free]]
            won = free & (self.keys[at] == keys[todo])
            self.slots[at[won]] = slots[todo[won]]
            todo, at = todo[~won], at[~won] + np.uint64(1) & self.mask

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these slots in order, and how many each has."""
        count = self.count[slots].astype(np.int64)
        ends = np.cumsum(count)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[slots] - ends + count, count)
        return self.pool[at], count


class WordBpe:
    """Encoder and decoder of one tokenizer file (byte-level BPE with word ends)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.lib = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = {t[0] for t in self.special}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * self.size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        chars = _byte_chars()
        of = {c: b for b, c in enumerate(chars)}
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in chars], np.int32)
        pairs = []
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ", 1)
            pairs.append((vocab[a], vocab[b], rank, vocab[a + b]))
        p = np.array(pairs, np.int64)
        key = p[:, 0] * self.size + p[:, 1]
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], p[order, 2].astype(np.int32), p[order, 3].astype(np.int32)
        self.made_by_rank = p[:, 3].astype(np.int32)
        self.rank_of = {int(k): int(r) for k, r in zip(self.keys, self.ranks)}
        # Byte pairs inside some token: [0] with the second byte inside a word, [1] with it at a word's end.
        self.joined = np.zeros((2, 256, 256), bool)
        for t in vocab:
            ends = bool(self.suffix) and t.endswith(self.suffix)
            body = [of[c] for c in (t[: -len(self.suffix)] if ends else t)]
            for k in range(len(body) - 1):
                self.joined[int(ends and k == len(body) - 2), body[k], body[k + 1]] = True
        self.cls, self.low = _latin_tables()
        self.table = IdTable()
        self.odd: dict[str, np.ndarray] = {}
        self.wide_spaces = np.array(WIDE_SPACES, np.uint32)
        self.space_re = re.compile("[\\t-\\r \\x85\\xa0" + "".join(map(chr, WIDE_SPACES)) + "]")

    # -- fragments --

    def _encode_pieces(self, a: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that lie end to end in an array of UTF-8 bytes: how many each has, and all in order."""
        ends = np.cumsum(sizes)
        cut = ~self.joined[0][a[:-1], a[1:]]
        two = ends[sizes > 1] - 2
        cut[two] = ~self.joined[1][a[two], a[two + 1]]
        cut[ends[:-1] - 1] = True
        stop = np.append(np.flatnonzero(cut) + 1, len(a))
        start = np.concatenate(([0], stop[:-1]))
        last = np.isin(stop, ends, assume_unique=True)
        base = np.where(self._at(len(a), ends - 1), self.last[a], self.inner[a])
        size = stop - start
        n_ids = np.zeros(len(start), np.int64)
        out = np.zeros(len(a), np.int32)  # ids of a fragment from the place of its first byte on
        for n in np.unique(size[size <= MATRIX_LEN]).tolist():
            which = np.flatnonzero(size == n)
            for s in range(0, len(which), 16_384):
                w = which[s : s + 16_384]
                n_ids[w] = self._merge_matrix(base[start[w][:, None] + np.arange(n)], start[w], out)
        for f in np.flatnonzero(size > MATRIX_LEN).tolist():
            ids = self._merge_heap(base[start[f] : stop[f]].tolist())
            n_ids[f] = len(ids)
            out[start[f] : start[f] + len(ids)] = ids
        at = np.arange(int(n_ids.sum())) + np.repeat(start - np.cumsum(n_ids) + n_ids, n_ids)
        piece_of = np.cumsum(last) - last
        return np.bincount(piece_of, n_ids, len(sizes)).astype(np.int64), out[at]

    @staticmethod
    def _at(n: int, where: np.ndarray) -> np.ndarray:
        mask = np.zeros(n, bool)
        mask[where] = True
        return mask

    def _merge_matrix(self, ids: np.ndarray, place: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Merge rows of equal length: in every round each row merges its leftmost pair of lowest rank.  Returns how many ids
        each row has, having put them into out."""
        n_ids = np.ones(len(ids), np.int64)
        alive = np.arange(len(ids))
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        while True:
            w = ids.shape[1]
            if w > 1:
                best = ranks.argmin(axis=1)
                low = ranks[np.arange(len(alive)), best]
                done = low == NONE
            else:
                done = np.ones(len(alive), bool)
            if done.any():
                n_ids[alive[done]] = w
                out[place[alive[done]][:, None] + np.arange(w)] = ids[done]
                keep = ~done
                alive, ids = alive[keep], ids[keep]
                if not len(alive):
                    return n_ids
                ranks, best, low = ranks[keep], best[keep], low[keep]
            rows = np.arange(len(alive))
            cols = np.arange(w - 1)
            ids = np.take_along_axis(ids, cols + (cols > best[:, None]), axis=1)
            ids[rows, best] = self.made_by_rank[low]
            if w > 2:
                ranks = np.take_along_axis(ranks, cols[:-1] + (cols[:-1] >= best[:, None]), axis=1)
                r, b = rows[best > 0], best[best > 0]
                ranks[r, b - 1] = self._ranks(ids[r, b - 1], ids[r, b])
                r, b = rows[best < w - 2], best[best < w - 2]
                ranks[r, b] = self._ranks(ids[r, b], ids[r, b + 1])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE).astype(np.int32)

    def _merge_heap(self, ids: list[int]) -> list[int]:
        """Ids of one long fragment in n log n."""
        n, size, rank = len(ids), self.size, self.rank_of
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = int(self.made_by_rank[r]), -1
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for s, e in ((prev[i], i), (i, nxt[i])):
                if s >= 0 and e >= 0 and (q := rank.get(ids[s] * size + ids[e])) is not None:
                    heapq.heappush(heap, (q, s, ids[s], ids[e]))
        return [x for x in ids if x >= 0]

    def _odd_ids(self, word: str) -> np.ndarray:
        """Ids of a word by way of the file's own normalizer and pre-tokenizer."""
        got = self.odd.get(word)
        if got is None:
            shown = self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(word))
            pieces = [bytes(map(_byte_of().__getitem__, t)) for t, _ in shown]
            a = np.frombuffer(b"".join(pieces), np.uint8)
            got = self._encode_pieces(a, np.array([len(x) for x in pieces]))[1] if len(a) else np.zeros(0, np.int32)
            if len(self.odd) > CACHE_PIECES // 8:
                self.odd = {}
            if len(word) < 1000:
                self.odd[word] = got
        return got

    def _pieces(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """Lower-cased Latin-1 array, starts and ends of pieces in it, and the spans of words with other characters."""
        wide = cp > 255
        a = cp.astype(np.uint8)
        cls, odd = self.cls[a], []
        if wide.any():
            at = np.flatnonzero(wide)
            cls[at] = np.where(np.isin(cp[at], self.wide_spaces), SPACE, ODD)
            if (at := at[cls[at] == ODD]).size:
                gap = np.flatnonzero(cls == SPACE)
                k = np.unique(np.searchsorted(gap, at))
                s = np.where(k > 0, gap[k - 1] + 1, 0)
                odd = list(zip(s.tolist(), np.append(gap, len(cp))[k].tolist()))
                for x, y in odd:
                    cls[x:y] = SPACE
        a = self.low[a]
        before = np.concatenate(([SPACE], cls[:-1])).astype(np.uint8)
        begins = ((cls != before) | (cls == NUMBER)) & (cls != SPACE)
        q = np.flatnonzero((a == 39) & (cls == OTHER) & begins)
        q = q[q + 1 < len(a)]
        if q.size:
            x, y = a[q + 1], np.where(cls[np.minimum(q + 2, len(a) - 1)] == LETTER, a[np.minimum(q + 2, len(a) - 1)], 0)
            letter = cls[q + 1] == LETTER
            two = letter & np.isin(x, np.frombuffer(b"stmd", np.uint8))
            three = letter & (((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108))
            for hit, n in ((two, 2), (three, 3)):
                p = q[hit]
                begins[p + 1] = False
                p = p[p + n < len(a)] + n
                begins[p[cls[p] == LETTER]] = True
        start = np.flatnonzero(begins)
        edge = begins.copy()
        edge[(cls == SPACE) & (before != SPACE)] = True
        stops = np.append(np.flatnonzero(edge), len(a))
        end = stops[np.searchsorted(stops, start, side="right")]
        return a, start, end, odd

    def _store(self, a: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Slots for pieces of a Latin-1 array, encoded anew."""
        sizes = e - s
        chars = a[np.arange(int(sizes.sum())) + np.repeat(s - np.cumsum(sizes) + sizes, sizes)]
        utf8, wide = chars, sizes
        if (high := chars > 127).any():
            wide = sizes + np.add.reduceat(high, np.cumsum(sizes) - sizes)
            utf8 = np.frombuffer(chars.tobytes().decode("latin-1").encode(), np.uint8)
        return self.table.store(chars, sizes, *self._encode_pieces(utf8, wide))

    def _encode_array(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of an array of code points, where each piece or word starts, and how many ids it has."""
        a, start, end, odd = self._pieces(cp)
        keys = span_hashes(a, start, end) | np.uint64(1)
        slots = self.table.find(keys)
        if (new := np.flatnonzero(slots < 0)).size:
            if self.table.n + len(new) > CACHE_PIECES:
                self.table.clear()
                new = np.arange(len(keys))
            some, first = np.unique(keys[new], return_index=True)
            self.table.add(some, self._store(a, start[new[first]], end[new[first]]))
            slots = self.table.find(keys)
        other = np.flatnonzero(~same_spans(a, start, end, self.table.text, self.table.begin[slots], self.table.size[slots]))
        if other.size:  # pieces with the hash of another one
            slots[other] = self._store(a, start[other], end[other])
        ids, count = self.table.gather(slots)
        if odd:
            words = [cp[s:e].tobytes().decode("utf-32-le") for s, e in odd]
            extra = [self._odd_ids(w) for w in words]
            at = np.concatenate([start, np.array([s for s, _ in odd])])
            order = np.argsort(at, kind="stable")
            n = np.concatenate([count, [len(x) for x in extra]])
            first = np.concatenate([np.cumsum(count) - count, len(ids) + np.cumsum([0, *map(len, extra)])[:-1]])
            ids = np.concatenate([ids, *extra]).astype(np.uint32)
            start, count = at[order], n[order].astype(np.int64)
            ids = ids[np.arange(int(count.sum())) + np.repeat(first[order] - np.cumsum(count) + count, count)]
        return ids, start, count

    def _parts(self, text: str) -> list[str]:
        """A long text cut at white space."""
        out, s = [], 0
        while len(text) - s > SLICE:
            m = self.space_re.search(text, s + SLICE)
            e = m.end() if m else len(text)
            out.append(text[s:e])
            s = e
        return [*out, text[s:]]

    def forget(self) -> None:
        """Free the tables of pieces: the worker may go on with other work."""
        self.table, self.odd = IdTable(), {}

    # -- documents --

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, as the library's encode without special tokens added."""
        parts: list[str] = []
        owner: list[int] = []
        fixed: dict[int, int] = {}
        for i, t in enumerate(texts):
            for x in self.special_re.split(t) if self.special_re and any(c in t for c in self.marks) else [t]:
                if x in self.special:
                    fixed[len(parts)] = self.special[x]
                for y in [""] if x in self.special else self._parts(x):
                    parts.append(y)
                    owner.append(i)
        done: list[bytes] = []
        for s, e in slices([len(x) for x in parts], SLICE):
            some = parts[s:e]
            cp = np.frombuffer("\n".join(some).encode("utf-32-le"), np.uint32)
            ids, start, count = self._encode_array(cp)
            off = np.cumsum([0, *(len(x) + 1 for x in some)])
            at = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(start, off)].tolist()
            flat = ids.astype("<u4").tobytes()
            done += [flat[4 * x : 4 * y] for x, y in zip(at, at[1:])]
        for k, token in fixed.items():
            done[k] = token.to_bytes(4, "little")
        if len(parts) == len(texts):
            return done
        out: list[list[bytes]] = [[] for _ in texts]
        for i, x in zip(owner, done):
            out[i].append(x)
        return [b"".join(x) for x in out]

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids, skip_special_tokens=False) without a decoder: tokens joined by a space."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


class LibraryBpe(WordBpe):
    """The same with the tokenizers library as the encoder of new pieces and odd words: both are encoded alike alone and in a text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core; the library's threads cost time and memory
        super().__init__(path)

    def _encode_pieces(self, a: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, ends = a.tobytes(), np.cumsum(sizes).tolist()
        words = [raw[s:e].decode() for s, e in zip([0, *ends], ends)]
        ids = [x.ids for k in range(0, len(words), LIBRARY_BATCH) for x in self.lib.encode_batch(words[k : k + LIBRARY_BATCH], add_special_tokens=False)]
        return np.array([len(x) for x in ids], np.int64), np.array([i for x in ids for i in x], np.int32)

    def _odd_ids(self, word: str) -> np.ndarray:
        if word not in self.odd:
            if len(self.odd) > CACHE_PIECES // 8:
                self.odd = {}
            got = np.array(self.lib.encode(word, add_special_tokens=False).ids, np.int32)
            if len(word) >= 1000:
                return got
            self.odd[word] = got
        return self.odd[word]


@lru_cache(1)
def _byte_of() -> dict[str, int]:
    return {c: b for b, c in enumerate(_byte_chars())}


@lru_cache(2)
def load(path: str, library: bool = False) -> WordBpe:
    """One encoder for each worker process and file."""
    return LibraryBpe(path) if library else WordBpe(path)


def encode_batches(batches, path: str, text: int, library: bool = False):
    """Of each Arrow batch: its other columns and the list of ids, in slices of bounded length."""
    bpe = load(path, library)
    for batch in batches:
        texts = batch.column(text).to_pylist()
        for s, e in slices([len(t or "") for t in texts], SLICE):
            yield batch.slice(s, e - s), bpe.encode_batch([t or "" for t in texts[s:e]])
    if not library:  # whose ids are dear: the bounded table stays for the worker's next task
        bpe.forget()


def bpe_encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids: binary, little-endian unsigned 32-bit token ids of every whole text (null: no ids).

    A map over rows without a shuffle; repeated rows and null keys stay as they are, other columns are left out."""
    small_batches(df.sparkSession)
    src = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def run(batches):
        for rows, ids in encode_batches(batches, path, 1):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.binary())], names=["k", "ids"])

    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, ids binary").select(F.col("k").alias(key), "ids")


def bpe_decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, ids, decoded: the text of binary ids (null or empty: empty)."""
    small_batches(df.sparkSession)
    src = df.select(F.col(key).alias("k"), F.col(ids).alias("ids"))

    def run(batches):
        bpe = load(path)
        for batch in batches:
            col = batch.column(1).to_pylist()
            for s, e in slices([len(x or b"") for x in col]):
                done = [bpe.decode(np.frombuffer(x or b"", "<u4")) for x in col[s:e]]
                yield pa.RecordBatch.from_arrays([*batch.slice(s, e - s).columns, pa.array(done, pa.string())], names=["k", "ids", "decoded"])

    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, ids binary, decoded string").select(F.col("k").alias(key), "ids", "decoded")


def bpe_round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids, decoded: bpe_encode and bpe_decode of every whole text in one worker.  Nulls, keys and repeated rows as there."""
    small_batches(df.sparkSession)
    src = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def run(batches):
        bpe = load(path)
        for rows, ids in encode_batches(batches, path, 1):
            done = [bpe.decode(np.frombuffer(x, "<u4")) for x in ids]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.binary()), pa.array(done, pa.string())], names=["k", "ids", "decoded"])

    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, ids binary, decoded string").select(F.col("k").alias(key), "ids", "decoded")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: the operators' ids and the text decoded from them.

    Null and empty texts have no ids and decode to the empty text; long texts are whole; repeated rows and null doc_ids stay as they
    are; other columns take no part, whatever their names; an empty table gives no rows."""
    both = bpe_round_trip(docs, path or tokenizer_path())
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
