"""Batch helpers for the Arrow stages: texts as one byte array with offsets, words as ranges in it.

All arrays cover one slice of a batch (``SLICE_BYTES`` of text, or a single longer text), so a
task's memory follows the slice and never the partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SLICE_BYTES = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)          # odd, so it has an inverse modulo 2**64
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

# What is not a word byte, as the contracts state it. Bytes from 0x80 on belong to words.
SPACE_SPLIT = np.ones(256, bool)
SPACE_SPLIT[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_SPLIT = np.ones(256, bool)
ALNUM_SPLIT[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Consecutive parts of a batch whose ``column`` holds about ``limit`` bytes each."""
    sizes = np.cumsum(np.diff(text_bytes(batch.column(column))[1]))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; a null is an empty text."""
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type)
                                or pa.types.is_large_string(array.type) else b"")
    array = array.cast(pa.large_binary())
    _, offsets, data = array.buffers()
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[array.offset:array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def ranges(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``mask``; a run never crosses a text's end."""
    before = np.zeros(len(mask) + 1, bool)
    before[1:] = mask
    after = np.zeros(len(mask) + 1, bool)
    after[:-1] = mask
    before[offsets] = False
    after[offsets] = False
    starts = np.flatnonzero(mask & ~before[:-1])
    ends = np.flatnonzero(mask & ~after[1:]) + 1
    return starts, ends


def owner(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which text each position lies in."""
    return np.searchsorted(offsets, starts, "right") - 1


def grouped(texts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The order by text, then value: one fast sort of values and one by the short text numbers."""
    order = np.argsort(values)
    short = texts.astype(np.uint16 if texts.max(initial=0) < 1 << 16 else np.int64)
    return order[np.argsort(short[order], kind="stable")]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """64-bit hashes of any byte ranges of a slice, by prefix sums of a polynomial."""

    def __init__(self):
        self._power = self._inverse = np.ones(1, np.uint64)

    def _tables(self, n: int) -> None:
        if len(self._power) <= n:
            self._power = np.full(n + 1, BASE)
            self._power[0] = 1
            self._inverse = np.full(n + 1, BASE_INVERSE)
            self._inverse[0] = 1
            self._power = np.cumprod(self._power)
            self._inverse = np.cumprod(self._inverse)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._tables(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._power[:len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self._inverse[starts])


def grams(hashes: np.ndarray, texts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside one text, and the number of the first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(hashes) - n + 1
    out = np.full(size, n, np.uint64)
    for i in range(n):
        out = mix(out * BASE + hashes[i:i + size])
    first = np.flatnonzero(texts[:size] == texts[n - 1:])
    return out[first], first


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)


def text_hash(text_col: str) -> Column:
    """With the id this names a document; rows that share both are repeated rows."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def on_document(base: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Join ``found`` (id, h, ...) to ``base`` (id, h, ...), null ids included."""
    found = found.toDF("_found_id", "_found_h", *found.columns[2:])
    return base.join(found, base["id"].eqNullSafe(found["_found_id"])
                     & (base["h"] == found["_found_h"]), how)


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, id, h): the row as one struct, so that its column names meet no others."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"),
                       F.col(id_col).alias("id"), text_hash(text_col).alias("h"))
