"""64-bit hashes of many spans of an array of bytes at once.

A span is read as 8-byte words that are mixed in turn, so spans of up to 8 bytes of one length never collide, and no algebraic
structure of the text (as with polynomials modulo 2 ** 64) makes longer ones collide.  Spans beyond LONG bytes go through BLAKE2b.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

LONG = 256
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SIZE = np.random.default_rng(30).integers(1, 2**63, LONG + 1, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(a: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number; zeros follow the end."""
    return np.ndarray((len(a) + 1,), "<u8", np.concatenate([a, np.zeros(8, np.uint8)]).data, strides=(1,))


def same_spans(a: np.ndarray, start: np.ndarray, end: np.ndarray, b: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[start:end] equals b[begin:begin + size], for each span."""
    x, y = _words(a), _words(b)
    out = end - start == size
    at, done = np.flatnonzero(out), 0
    while len(at):
        left = size[at] - done
        mask = _MASK[np.clip(left, 0, 8)]
        good = (x[start[at] + done] & mask) == (y[begin[at] + done] & mask)
        out[at[~good]] = False
        done += 8
        at = at[good & (left > 8)]
    return out


def span_hashes(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash (uint64) of a[start:end] of each span; a: uint8."""
    if not len(start):
        return np.zeros(0, np.uint64)
    words = _words(a)
    size = end - start
    h = mix((words[start] & _MASK[np.minimum(size, 8)]) ^ _SIZE[np.minimum(size, LONG)])
    at = np.flatnonzero((size > 8) & (size <= LONG))
    done = 8
    while len(at):
        left = size[at] - done
        word = words[start[at] + done] & _MASK[np.minimum(left, 8)]
        h[at] = mix(h[at] * np.uint64(0x9E3779B97F4A7C15) + word)
        done += 8
        at = at[left > 8]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(blake2b(a[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h
