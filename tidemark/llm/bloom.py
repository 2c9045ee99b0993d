"""Bloom filters that executors fill and tasks test: they thin out what is joined, and never decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.blocks import U64, mix
from tidemark.llm.common import lean

#: log2 of the fewest and most bits of a filter: 8 KB to 16 MB
LEAST_BITS, MOST_BITS = 16, 27
#: bits for each key, up to the most
PER_KEY = 16
#: tasks that fill filters: each sends one, whatever the number of keys
TASKS = 16


def bits_for(keys: int) -> int:
    """log2 of the bits of a filter of so many keys; beyond MOST_BITS more keys pass by chance."""
    return min(MOST_BITS, max(LEAST_BITS, (PER_KEY * max(keys, 1) - 1).bit_length()))


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (mix(h, 4) >> U64(64 - bits)).astype(np.int64), (mix(h, 5) >> U64(64 - bits)).astype(np.int64)


def passes(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each hash whether it may be a key."""
    a, b = _places(h, (8 * len(bloom) - 1).bit_length())
    return ((bloom[a >> 3] >> (a & 7).astype(np.uint8)) & (bloom[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def bloom_of(keys: DataFrame, bits: int) -> np.ndarray:
    """The filter of the keys, one column of longs.  Each task sends a filter of fixed size, of which only bytes that are set."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = np.zeros(1 << (bits - 3), dtype=np.uint8)
        for b in batches:
            for p in _places(b.column(0).to_numpy().view(U64), bits):
                np.bitwise_or.at(bloom, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))
        at = np.flatnonzero(bloom)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype("<u4").tobytes()]), pa.array([bloom[at].tobytes()])], names=["at", "bits"])

    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for row in keys.coalesce(TASKS).mapInArrow(lean(fill), "at binary, bits binary").toLocalIterator():
        out[np.frombuffer(row["at"], "<u4")] |= np.frombuffer(row["bits"], np.uint8)
    return out
