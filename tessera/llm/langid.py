"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts counts the n-grams (2 to 4 bytes of lower-case UTF-8, other characters than
letters as one space) that both have, over the geometric mean of how many each has.  N-grams are hashed to DIM columns.  Texts
are cut into windows of WINDOW bytes, since all n-grams are present in a long text; a text's score is the mean of its windows',
weighted by length, so the whole text counts.

Landmarks (windows of the training sample, as many of each language) give the Nyström map; kernel ridge regression on it, one
language against the rest, gives a matrix from kernel values to scores.  Windows are scored in batches: presence matrix times
landmarks, then times that matrix.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, small_batches

DIM, WINDOW, ORDERS = 8192, 1500, (2, 3, 4)
#: The model is fitted on about this many labelled documents of each language at most (those of the lowest hash of doc_id), and
#: this many windows of each; documents far beyond the bound add nothing to a model of this size.
TRAIN_DOCS, TRAIN_WINDOWS, LANDMARKS = 600, 900, 48
#: Windows of one document in the sample at most, by hash over its whole text.
DOC_WINDOWS = 4
RIDGE = 0.3
BATCH = 192
#: Code points whose windows are made at a time.
SLICE = 1_000_000
UNKNOWN = "und"

# Bytes of ASCII that are no letters become a space.
_LETTERS = np.full(256, 32, np.uint8)
for _c in [*range(97, 123), *range(128, 256)]:
    _LETTERS[_c] = _c
_ASCII_LETTER = re.compile("[A-Za-z]")
_MULT = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text))


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all windows end to end, the window of each byte, and the text of each window."""
    parts, owner, start = [], [], [0]
    for i, t in enumerate(texts):
        a = _LETTERS[np.frombuffer(b" " + t.lower().encode() + b" ", np.uint8)]
        space = a == 32
        a = a[~(space & np.concatenate(([False], space[:-1])))]
        n = max(1, round(len(a) / WINDOW))
        edge = np.linspace(0, len(a), n + 1).astype(int)
        start += (start[-1] + edge[1:]).tolist()
        owner += [i] * n
        parts.append(a)
    data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return data, np.repeat(np.arange(len(owner)), np.diff(start)), np.array(owner, np.int64)


def presence(data: np.ndarray, window: np.ndarray, n: int) -> np.ndarray:
    """0/1 matrix of n windows and DIM hashed n-grams; window: of each byte, from 0 on."""
    out = np.zeros((n, DIM), np.uint8)
    flat = out.reshape(-1)
    wide = data.astype(np.uint32) + np.uint32(1)
    row = window.astype(np.int64) * DIM
    h = wide * _MULT[0]
    for k in range(2, max(ORDERS) + 1):
        if len(data) < k:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + wide[k - 1 :] * _MULT[k - 1]
        if k in ORDERS:
            code = ((h ^ (h >> np.uint32(13))) * _MULT[1]) >> np.uint32(19)
            same = window[: len(h)] == window[k - 1 :]
            flat[(row[: len(h)] + code)[same]] = 1
    return out


class Model:
    """Landmark presence rows, scaled, and the matrix from kernel values to the scores of languages."""

    def __init__(self, langs: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.langs, self.landmarks, self.weights = langs, landmarks, weights

    @staticmethod
    def scaled(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    @classmethod
    def fit(cls, x: np.ndarray, lang: list[str]) -> "Model":
        langs = sorted(set(lang))
        y = np.array([langs.index(v) for v in lang])
        marks = np.concatenate([np.flatnonzero(y == c)[:LANDMARKS] for c in range(len(langs))])
        x = cls.scaled(x)
        land = x[marks]
        values, vectors = np.linalg.eigh((land @ land.T).astype(np.float64))
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        phi = (x @ land.T).astype(np.float64) @ root
        target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
        weight = len(y) / len(langs) / np.bincount(y, minlength=len(langs))[y]
        left = phi.T @ (phi * weight[:, None]) + RIDGE * np.eye(phi.shape[1])
        fitted = np.linalg.solve(left, phi.T @ (target * weight[:, None]))
        return cls(langs, np.ascontiguousarray(land.T), (root @ fitted).astype(np.float32))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) @ self.landmarks) @ self.weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score (0 to 1) of each whole text."""
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not known:
            return lang, score
        data, window, owner = windows([texts[i] for i in known])
        size = np.bincount(window, minlength=len(owner)).astype(np.float64)
        total = np.zeros((len(known), len(self.langs)))
        edge = np.concatenate(([0], np.cumsum(size))).astype(int)
        for s in range(0, len(owner), BATCH):
            e = min(len(owner), s + BATCH)
            got = self.scores(presence(data[edge[s] : edge[e]], window[edge[s] : edge[e]] - s, e - s))
            np.add.at(total, owner[s:e], got * size[s:e, None])
        total /= np.bincount(owner, size)[:, None]
        best = total.argmax(axis=1)
        for i, b, v in zip(known, best.tolist(), total[np.arange(len(best)), best].tolist()):
            lang[i], score[i] = self.langs[b], min(1.0, max(0.0, (v + 1) / 2))
        return lang, score


def training_windows(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame | None:
    """l, k, w, bits (DIM / 8 bytes of packed presence) of windows w of labelled rows: for each language the TRAIN_WINDOWS of lowest
    hash of DOC_WINDOWS each of about TRAIN_DOCS rows.  None without labelled rows.

    Labels and keys are counted over all rows; only the sample's texts are read further."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    share = F.pmod(F.xxhash64(F.lit("langid"), F.col(key)), F.lit(1_000_000)).cast("long")
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return None
    limit = F.lit(0)
    for value, n in sorted(counts.items()):
        limit = F.when(F.col(lang) == value, F.lit(int(1_000_000 * TRAIN_DOCS / n) + 1)).otherwise(limit)
    src = rows.where(share < limit).select(F.col(lang).cast("string").alias("l"), F.col(text).cast("string").alias("t"), F.col(key).cast("string").alias("k"))

    def run(batches):
        for batch in batches:
            langs, texts, keys = (batch.column(i).to_pylist() for i in range(3))
            for s, e in slices([len(t) for t in texts], SLICE):
                data, window, owner = windows(texts[s:e])
                edge = np.searchsorted(window, np.arange(len(owner) + 1))
                first = np.searchsorted(owner, np.arange(e - s + 1))
                for i in range(e - s):
                    at = sorted(range(first[i + 1] - first[i]), key=lambda w: _window_hash(keys[s + i], w))[:DOC_WINDOWS]
                    bits = [np.packbits(presence(data[edge[w] : edge[w + 1]], window[edge[w] : edge[w + 1]] - w, 1)).tobytes() for w in first[i] + np.array(at, int)]
                    h = [_window_hash(keys[s + i], w) for w in at]
                    yield pa.RecordBatch.from_arrays([pa.array([langs[s + i]] * len(at)), pa.array([keys[s + i]] * len(at)), pa.array(at, pa.int64()), pa.array(h, pa.int64()), pa.array(bits, pa.binary())], names=["l", "k", "w", "h", "bits"])

    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "k", "w", "bits"))
    return src.mapInArrow(run, "l string, k string, w long, h long, bits binary").withColumn("rank", rank).where(F.col("rank") <= TRAIN_WINDOWS).select("l", "k", "w", "bits")


def _window_hash(key: str, w: int) -> int:
    return int.from_bytes(blake2b(f"{key}/{w}".encode(), digest_size=8).digest(), "little", signed=True)


def fit_model(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """A model fitted on the training windows of docs; only these come to the driver.

    Rows with a null text, label or key, and empty texts, teach nothing; repeated rows count as often as they occur; without labelled
    rows the model knows no language and every text is UNKNOWN."""
    sample = training_windows(docs, text, lang, key)
    if sample is None:
        return Model([], np.zeros((DIM, 0), np.float32), np.zeros((0, 0), np.float32))
    got = sorted((r.l, r.k, r.w, bytes(r.bits)) for r in sample.collect())
    order = np.random.default_rng(2).permutation(len(got))
    x = np.unpackbits(np.frombuffer(b"".join(got[i][3] for i in order), np.uint8).reshape(-1, DIM // 8), axis=1)
    return Model.fit(x, [got[i][0] for i in order])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score of every whole text; a null text or one without a letter is UNKNOWN, 0.

    Columns of these names in docs are replaced, all others stay whatever their names.  Repeated rows and null ids stay; of languages
    with equal scores the first by name is taken; long texts are whole; an empty table gives no rows."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("lang_pred", "lang_score")
    n = len(docs.columns)
    shared = spark.sparkContext.broadcast(model)
    src = docs.withColumn("t" + "".join(docs.columns), F.col(text).cast("string"))  # a name that no column has

    def run(batches):
        for batch in batches:
            texts = batch.column(n).to_pylist()
            for s, e in slices([len(t or "") for t in texts], SLICE):
                lang, score = shared.value.predict(texts[s:e])
                yield pa.RecordBatch.from_arrays([*batch.slice(s, e - s).columns[:n], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[:n], "lang_pred", "lang_score"])

    from pyspark.sql import types as T

    return src.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))


def held_out(key: str = "doc_id"):
    """Documents whose crc32 of the id as text is a multiple of 5, and those without an id."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(True))


def op2_predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; a null doc_id counts as held out.  For nulls, long texts, ties, repeated rows
    and other columns see identify and fit_model."""
    model = fit_model(docs.where(~held_out()))
    got = identify(docs.select("doc_id", "text"), model)
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
