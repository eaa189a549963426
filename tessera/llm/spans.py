"""Texts whose characters remember the source span they came from, and the digests of span lists."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

SPAN_TYPE = "array<struct<kind:string,start:long,end:long,base:boolean,value:string>>"
SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("value", pa.string())]))


class Mapped:
    """A text and, for each of its characters, the source span [start, end) in code points."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text = text
        self.start = np.arange(len(text)) if start is None else start
        self.end = self.start + 1 if end is None else end

    def source(self, s: int, e: int) -> tuple[int, int]:
        return int(self.start[s]), int(self.end[e - 1])

    def sub(self, pattern: re.Pattern, change) -> "Mapped":
        """The text with change(match) in place of each match; all its characters map to the match's whole source span, unless
        change also returns the start and end of each of them within the match.  None leaves a match as it is."""
        out, s, e, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = change(m)
            if new is None or m.end() == m.start():
                continue
            if isinstance(new, tuple):
                new, first, last = new
                a, b = self.start[m.start() + first], self.end[m.start() + last - 1]
            else:
                a, b = (np.full(len(new), x) for x in self.source(m.start(), m.end()))
            out += [self.text[at : m.start()], new]
            s += [self.start[at : m.start()], a]
            e += [self.end[at : m.start()], b]
            at = m.end()
        if not out:
            return self
        return Mapped("".join([*out, self.text[at:]]), np.concatenate([*s, self.start[at:]]), np.concatenate([*e, self.end[at:]]))

    def chars(self, table: dict[int, str]) -> "Mapped":
        """Single characters replaced by a table of ord to string (empty: removed)."""
        hit = re.compile("[" + "".join(re.escape(chr(c)) for c in table) + "]")
        return self.sub(hit, lambda m: table[ord(m[0])])


def map_spans(df: DataFrame, find, key: str, text: str, out: str) -> DataFrame:
    """key and out: find(text) of every whole text (null: empty), as spans ordered by start, then kind as find lists them."""
    small_batches(df.sparkSession)
    src = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s, e in slices([len(t or "") for t in texts]):
                rows = [[dict(zip(("kind", "start", "end", "base", "value"), x)) for x in find(t or "")] for t in texts[s:e]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array(rows, SPAN_ARROW)], names=["k", "spans"])

    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, spans {SPAN_TYPE}").select(F.col("k").alias(key), F.col("spans").alias(out))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(df: DataFrame, kinds: tuple[str, ...], key: str, spans: str) -> DataFrame:
    """key, n_<kind> of the base spans, base_sha256, spans."""
    base = F.filter(F.col(spans), lambda x: x["base"])
    count = [F.size(F.filter(F.col(spans), _is(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return df.select(key, *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"))


def _is(kind: str):
    return lambda x: x["base"] & (x["kind"] == kind)


def ordered(found: set, text: str, kinds: tuple[str, ...], base: list) -> list[tuple]:
    """(kind, start, end, base, value) by start, then kind, then end; found: added (kind, start, end, value).

    Different values from one source span stay apart, as one encoded run can hold several."""
    rank = {k: i for i, k in enumerate(kinds)}
    rows = [(k, s, e, True, text[s:e]) for k, s, e in base]
    known = {(k, s, e, v) for k, s, e, _, v in rows}
    rows += [(k, s, e, False, v) for k, s, e, v in found if (k, s, e, v) not in known]
    return sorted(rows, key=lambda x: (x[1], rank[x[0]], x[2], not x[3], x[4]))
