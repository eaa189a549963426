"""Secret scans with a recursive decoding worklist.

The source text is the first layer.  Every layer is scanned; then its percent escapes and Unicode escapes are undone, and its
base64 runs are decoded, and what comes out compressed is unpacked.  Each new text is a layer of the worklist, until no layer
gives a new one: a layer whose text was seen before at the same source span is dropped, which also ends cycles.  Layers remember
the source span of each character, so findings map back to the document.

Percent and Unicode escapes are undone character by character, so findings keep exact spans; what a compressed run holds maps to the
whole run, and several findings in one stay apart by their values.  Base64 runs are also joined over line breaks.  Bytes that are not nearly all printable UTF-8 are read as Latin-1.  Streams that
unpack to more than a block are read block by block; blocks end and overlap at line ends.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import io
import lzma
import re
import zlib
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, small_batches
from .spans import Mapped, digest, map_spans, ordered

KINDS = ("assign", "access", "hex")
#: Most bytes of a compressed run that are unpacked and scanned at a time (decompression bombs stay small), of which so many are in
#: the next block again.
UNPACK_BYTES, OVERLAP = 16_000_000, 65_536
#: Bytes that a decompressor returns at once.
PIECE = 1_000_000
#: Shortest base64 run that is decoded, and how far into a run a path may reach that stands before it.
BASE64_CHARS, PATH = 16, 256

# The base patterns.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})+")
UNICODE_ONE = re.compile(r"\\(?:u\{([0-9A-Fa-f]+)\}|[uUx]([0-9A-Fa-f]+))")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % BASE64_CHARS)
#: The same over line breaks.  Possessive runs and the look-behind keep long runs linear.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]++)+={0,2}" % BASE64_CHARS)
PART = re.compile(r"[A-Za-z0-9+/_-]+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that are long enough (the minimum lengths of access and hex are in their
    patterns, which gives the same runs: each run is maximal)."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def _decompressor(head: bytes):
    """For the first bytes of a gzip, zlib, bzip2 or xz stream; None for others."""
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=1 << 26)
    return None


class _Chunks(io.RawIOBase):
    """Chunks as a file."""

    def __init__(self, chunks):
        self.chunks, self.rest = chunks, b""

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        self.rest = self.rest or next(self.chunks, b"")
        out, self.rest = (self.rest, b"") if n < 0 else (self.rest[:n], self.rest[n:])
        return out


def _pieces(data: bytes, more):
    """What the stream that begins with data and goes on with more unpacks to, member by member, as far as it is sound."""
    try:
        if data[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard

            reader = zstandard.ZstdDecompressor().stream_reader(_Chunks(chain([data], more)), read_across_frames=True)
            while out := reader.read(PIECE):
                yield out
            return
        d = _decompressor(data)
        while d is not None:
            if out := d.decompress(data, PIECE):
                yield out
            if d.eof:
                data = d.unused_data or next(more, b"")
                d = _decompressor(data)
            else:
                data = getattr(d, "unconsumed_tail", b"")
                if not data and getattr(d, "needs_input", True):
                    data = next(more, b"")
                    if not data:
                        return
    except Exception:  # noqa: BLE001 - not such a stream after all, or broken off
        return


def unpack(data: bytes):
    """Blocks of what a gzip, zlib, bzip2, xz or zstandard stream holds, also one in another; none if data is none of them."""
    if not _is_stream(data):
        return
    pieces = _pieces(data, iter(()))
    first = next(pieces, b"")
    for _ in range(100):
        if not _is_stream(first):
            break
        inner = _pieces(first, pieces)
        held = next(inner, b"")
        if not held:
            break
        pieces, first = inner, held
    block = bytearray(first)
    for piece in pieces:
        block += piece
        if len(block) > UNPACK_BYTES:
            cut = block.rfind(b"\n", 0, UNPACK_BYTES) + 1 or UNPACK_BYTES
            yield bytes(block[:cut])
            back = max(1, cut - OVERLAP)
            line = block.find(b"\n", back, cut - 1) + 1
            del block[: line or back]
    if block:
        yield bytes(block)


def _is_stream(data: bytes) -> bool:
    return data[:4] == b"\x28\xb5\x2f\xfd" or _decompressor(data) is not None


def readable(data: bytes) -> str:
    """The text of bytes that are UTF-8 and nearly all printable; else each byte as a character."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")
    odd = sum(1 for c in text if not (c.isprintable() or c in "\t\r\n"))
    return text if odd * 20 <= len(text) else data.decode("latin-1")


def _utf16(data: bytes) -> str | None:
    """Bytes read as UTF-16, if one of two bytes is zero in a tenth of the pairs or more; they may be something else as well."""
    if len(data) < 8:
        return None
    low, high = data[1::2].count(0), data[::2].count(0)
    if max(low, high) * 20 < len(data):
        return None
    return data[: len(data) // 2 * 2].decode("utf-16-le" if low >= high else "utf-16-be", "replace")


def _texts(data: bytes):
    """The texts in bytes: blocks of what they unpack to, or else themselves; with whether positions of bytes are kept."""
    packed = False
    for block in unpack(data):
        packed = True
        yield readable(block), False
        if wide := _utf16(block):
            yield wide, False
    if data and not packed:
        yield readable(data), True
        if wide := _utf16(data):
            yield wide, False


def _byte_layer(text: str, kept: bool, start: np.ndarray, end: np.ndarray) -> Mapped:
    """A layer of decoded bytes; start and end are the source spans of the bytes."""
    if not kept:
        return Mapped(text, np.full(len(text), start[0]), np.full(len(text), end[-1]))
    if len(text) == len(start):
        return Mapped(text, start, end)
    sizes = np.array([len(c.encode()) for c in text])
    stop = np.cumsum(sizes)
    return Mapped(text, start[stop - sizes], end[stop - 1])


def _unescape_percent(m: re.Match) -> tuple | None:
    """The bytes of a run as text, each character with its own escapes; None for a compressed stream."""
    data = bytes.fromhex(m[0].replace("%", ""))
    if _is_stream(data):
        return None
    text = readable(data)
    sizes = np.ones(len(text), int) if len(text) == len(data) else np.array([len(c.encode()) for c in text])
    last = np.cumsum(sizes) * 3
    return text, last - sizes * 3, last


def _unescape_unicode(m: re.Match) -> tuple | None:
    """The characters of a run of escapes, each with its own; two escapes of a surrogate pair are one character."""
    out, first, last = [], [], []
    for x in UNICODE_ONE.finditer(m[0]):
        unit = int(x[1] or x[2], 16)
        if unit > 0x10FFFF:
            return None
        if out and 0xDC00 <= unit < 0xE000 and 0xD800 <= out[-1] < 0xDC00:
            out[-1] = 0x10000 + ((out[-1] - 0xD800) << 10) + unit - 0xDC00
            last[-1] = x.end()
        else:
            out.append(unit)
            first.append(x.start())
            last.append(x.end())
    return "".join("\ufffd" if 0xD800 <= u < 0xE000 else chr(u) for u in out), np.array(first), np.array(last)


def decoded_layers(layer: Mapped):
    """The layers one decoding step below."""
    text = layer.text
    for mark, pattern, change in (("%", PERCENT, _unescape_percent), ("\\", UNICODE, _unescape_unicode)):
        if mark in text:
            new = layer.sub(pattern, change)
            if new is not layer:
                yield new
    for m in PERCENT.finditer(text) if "%" in text else ():
        data = bytes.fromhex(m[0].replace("%", ""))
        if _is_stream(data):
            at = np.arange(m.start(), m.end(), 3)
            for inner, kept in _texts(data):
                yield _byte_layer(inner, kept, layer.start[at], layer.end[at + 2])
    for m in BASE64.finditer(text):
        run = m[0].rstrip("=")
        yield from _base64_layers(layer, run, np.arange(m.start(), m.start() + len(run)))
        # a slash may end a path before the run, and is also a digit of it
        for k in [i + 1 for i, c in enumerate(run[:PATH]) if c == "/" and len(run) - i > BASE64_CHARS] if "/" in run[:PATH] and not _sound(run) else ():
            if k % 4 and _sound(run[k:]):
                yield from _base64_layers(layer, run[k:], np.arange(m.start() + k, m.start() + len(run)))
    for m in WRAPPED.finditer(text) if "\n" in text else ():
        lines = [x.span() for x in PART.finditer(text, *m.span())]
        for group in _groups(lines):
            yield from _base64_layers(layer, "".join(text[s:e] for s, e in group), np.concatenate([np.arange(s, e) for s, e in group]))


def _groups(lines: list[tuple[int, int]]):
    """All lines, and runs of lines of one length with the shorter one after them (lines before them may belong to no run)."""
    yield lines
    i = 0
    while i < len(lines):
        size, k = lines[i][1] - lines[i][0], i + 1
        while k < len(lines) and lines[k][1] - lines[k][0] == size:
            k += 1
        k += k < len(lines) and lines[k][1] - lines[k][0] < size
        if 1 < k - i < len(lines):
            yield lines[i:k]
        i = k


def _decoded(run: str) -> bytes:
    """The bytes of a base64 run; a last digit that stands alone is left out."""
    n = len(run) - (len(run) % 4 == 1)
    return base64.b64decode(run[:n].replace("-", "+").replace("_", "/") + "=" * (-n % 4))


def _sound(run: str) -> bool:
    """Whether a base64 run holds a compressed stream or printable UTF-8."""
    try:
        data = _decoded(run)
        return _is_stream(data) or readable(data) == data.decode()
    except (binascii.Error, UnicodeDecodeError):
        return False


def _base64_layers(layer: Mapped, run: str, at: np.ndarray):
    """Layers of a base64 run whose characters stand at these places of the layer's text."""
    n = len(run) - (len(run) % 4 == 1)
    try:
        data = _decoded(run)
    except binascii.Error:
        return
    for inner, kept in _texts(data):
        i = np.arange(len(data))
        yield _byte_layer(inner, kept, layer.start[at[i * 4 // 3]], layer.end[at[np.minimum((4 * (i + 1) + 2) // 3, n) - 1]])


def find_secrets(text: str) -> list[tuple]:
    """(kind, start, end, base, value): base matches of the text and those of all decoded layers, mapped to the text."""
    base = base_spans(text)
    found: set = set()
    work = [decoded_layers(Mapped(text))] if "%" in text or "\\" in text or BASE64.search(text) else []
    seen = {(_mark(text), 0, len(text))}
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        key = (_mark(layer.text), int(layer.start.min()), int(layer.end.max())) if layer.text else None
        if key and key not in seen:
            seen.add(key)
            for kind, s, e in base_spans(layer.text):
                found.add((kind, *layer.source(s, e), layer.text[s:e]))
            work.append(decoded_layers(layer))
    return ordered(found, text, KINDS, base)


def _mark(text: str) -> bytes:
    """What stands for a text among the texts seen."""
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "secrets") -> DataFrame:
    """key and out: array of struct kind, start, end, base, value of every whole text; null texts have none.

    A map over rows: repeated rows and null keys stay, other columns are left out."""
    return map_spans(df, find_secrets, key, text, out)


def redact(text: str) -> str:
    """The text with each run of touching or overlapping secret spans replaced by <kind>, the kind of its first span.

    What a replacement makes anew (two halves that now touch cannot, as a mark stands between them) is no secret."""
    out, at = [], 0
    for kind, s, e, *_ in sorted(find_secrets(text), key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def redact_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the secrets in every whole text replaced; null texts and all other columns stay as they are.  A map over rows."""
    small_batches(df.sparkSession)
    place = df.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for s, e in slices([len(t or "") for t in texts]):
                cols = batch.slice(s, e - s).columns
                cols[place] = pa.array([t if t is None else redact(t) for t in texts[s:e]], pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def op1_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> and base_sha256 of the base spans, and all spans, of every row.

    Null and empty texts have no spans; texts are whole however long; repeated rows and null doc_ids stay; spans with one start are
    ordered by kind, end and value; other columns take no part, whatever their names; an empty table gives no rows."""
    return digest(scan_secrets(docs), KINDS, "doc_id", "secrets")
