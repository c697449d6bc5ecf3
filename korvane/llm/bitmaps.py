"""Fixed-size bitmaps of 64-bit keys: a bounded broadcast that lets tasks skip most keys.

A bitmap never decides a result: a set bit only means that a key may be there, and what passes
is joined or checked afterwards. Its size is a parameter, whatever the number of keys.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

BUCKET_BITS = 32768       # what one bitmap of Spark's bitmap functions holds


def build(keys: DataFrame, column: str, bits: int) -> Broadcast:
    """Broadcast bitmap of ``2**bits`` bits over the keys; the driver gets those bits only."""
    slot = F.col(column).bitwiseAND((1 << bits) - 1) + 1
    rows = (keys.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).collect())
    data = np.zeros((1 << bits) // 8, np.uint8)
    for bucket, bitmap in rows:
        at = (bucket - 1) * BUCKET_BITS // 8
        data[at:at + len(bitmap)] = np.frombuffer(bitmap, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(data.tobytes())


class Bitmap:
    """The worker's view."""

    def __init__(self, shared: Broadcast):
        self._bytes = np.frombuffer(shared.value, np.uint8)
        self._mask = np.uint64(len(self._bytes) * 8 - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = keys & self._mask
        return ((self._bytes[(slot >> np.uint64(3)).astype(np.int64)]
                 >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
