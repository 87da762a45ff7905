"""A membership filter over 64-bit keys, sized by their number: built in tasks, merged by slices, sent to tasks.

It only saves work. Keys that are in the set always pass, and of others about one in twenty. A filter for more than
MOST_KEYS keys would be too large to send (128 MB), so such keys are joined instead; see ``fits``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from glossmill.llm.session import frugal
from glossmill.llm.wordhash import mix

SLICE = 1 << 16
#: Slices of a batch: 1 MB.
SENT = 16
MOST_KEYS = 1 << 27
BITS_PER_KEY = 8


def fits(keys: int) -> bool:
    return keys <= MOST_KEYS


def log2_for(keys: int) -> int:
    return max(20, (keys * BITS_PER_KEY - 1).bit_length())


def _places(keys: np.ndarray, log2_bits: int) -> list[np.ndarray]:
    shift, again = np.uint64(64 - log2_bits), mix(keys ^ np.uint64(0x5851F42D4C957F2D))
    return [(mix(keys) >> shift).astype(np.int64), (again >> shift).astype(np.int64)]


def contains(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for at in _places(keys, (8 * len(bits) - 1).bit_length()):
        found &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return found


def held(found: Broadcast | None, keys: np.ndarray) -> np.ndarray:
    """``contains``; without a filter, because of too many keys, all may be in the set."""
    return np.ones(len(keys), bool) if found is None else contains(found.value, keys)


def within(keys: DataFrame, count: int) -> Broadcast | None:
    """``build``, or no filter for too many keys."""
    return build(keys, count) if fits(count) else None


def build(keys: DataFrame, count: int) -> Broadcast:
    """From a DataFrame of one long column and its number of rows."""
    log2_bits = log2_for(count)
    n = 1 << (log2_bits - 3)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, some = np.zeros(n, np.uint8), False
        for batch in batches:
            some = some or batch.num_rows > 0
            for at in _places(batch.column(0).to_numpy().view(np.uint64), log2_bits):
                np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        if some:
            parts = {k: bits[k * SLICE : (k + 1) * SLICE] for k in range(-(-n // SLICE))}
            parts = {k: v.tobytes() for k, v in parts.items() if v.any()}
            for at in range(0, len(parts), SENT):
                some_parts = dict(list(parts.items())[at : at + SENT])
                yield pa.RecordBatch.from_arrays([pa.array(list(some_parts), pa.int32()), pa.array(list(some_parts.values()), pa.binary())], ["k", "bits"])

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, k = None, 0
        for pdf in parts:
            for k, raw in zip(pdf["k"], pdf["bits"], strict=True):
                x = np.frombuffer(raw, np.uint8)
                total = x.copy() if total is None else np.bitwise_or(total, x, out=total)
        if total is not None:
            yield pd.DataFrame({"k": [k], "bits": [total.tobytes()]})

    rows = keys.mapInArrow(frugal(fill), "k int, bits binary").groupBy("k").applyInPandas(by_batches(merge), "k int, bits binary").collect()
    bits = np.zeros(n, np.uint8)
    for r in rows:
        bits[r["k"] * SLICE : r["k"] * SLICE + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits)


def by_batches(f):
    """Annotations as objects, by which applyInPandas sees that f takes a group in batches."""
    f.__annotations__ = {"parts": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return f
