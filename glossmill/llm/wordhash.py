"""Vectorised hashing of words and word n-grams over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit, the same in every process:
a polynomial over per-byte random coefficients modulo 2**64, then an avalanche step. Texts are hashed in
segments of at most ``SEGMENT`` bytes cut at white space, so memory doesn't follow the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 17
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """An invertible avalanche of 64-bit values."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(29))
    x = x * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


_STEP = 0x9E3779B97F4A7C15
_BASE = 0xC2B2AE3D27D4EB4F
_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(_STEP))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Marks all ASCII but letters and digits, for words without punctuation.
MARKS = np.array([not chr(b).isalnum() if b < 128 else False for b in range(256)])
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SEGMENT + 1)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0]
    return raw, offsets - offsets[0]


def _marked(part: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """``marks[part]``, in a fifth of its time."""
    return np.frombuffer(part.tobytes().translate(marks.tobytes()), bool)


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes that ``white`` doesn't mark) in order, and for each text the range of its words (one more entry than texts)."""
    table = _LOWER if lower else _BYTES
    hashes, firsts = [], []
    at, n = 0, len(raw)
    while at < n:
        end = min(at + SEGMENT, n)
        if end < n:
            cut = np.flatnonzero(_marked(raw[at:end], white))
            inner = np.searchsorted(offsets, end, "right") - 1
            stop = max(at + cut[-1] + 1 if len(cut) else 0, offsets[inner])
            while stop <= at and end < n:  # one word longer than a segment
                end = min(end + SEGMENT, n)
                cut = np.flatnonzero(white[raw[at:end]])
                inner = np.searchsorted(offsets, end, "right") - 1
                stop = max(at + cut[-1] + 1 if len(cut) else 0, offsets[inner])
            end = stop if stop > at else n
        part = raw[at:end]
        solid = ~_marked(part, white)
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        edge = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, end, "left")] - at
        begins[edge] = solid[edge]
        ends[edge - 1] = solid[edge - 1]
        b, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, down = _power(len(part))
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(table[part] * up[: len(part)], out=sums[1:])
        hashes.append(mix((sums[e] - sums[b]) * down[b] + (e - b).astype(_U)))
        firsts.append(b + at)
        at = end
    if not hashes:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(firsts), offsets, "left")


def counted(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of each text's words."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for a, b in groups(offsets):
        part, places = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        solid = ~_marked(part, WHITE)
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        first = places[:-1][places[:-1] < len(part)]
        begins[first] = solid[first]
        out[a:b] = np.diff(np.searchsorted(np.flatnonzero(begins), places))
    return out


def ngrams(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the n words that start at each word; the last n - 1 positions are left out."""
    m = max(0, len(hashes) - n + 1)
    total = np.full(m, salt, _U)
    base = 0x9FB21C651E98DF25 ^ (salt << 1)
    for j in range(n):
        total = total * _U(base) + hashes[j : j + m]
    return mix(total)


def groups(offsets: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` bytes together."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end
        at = end
