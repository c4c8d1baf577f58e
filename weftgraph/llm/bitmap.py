"""Bounded bitmaps of hashed values, aggregated by Spark and shared with tasks."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PART = 32768


def hashed_bitmap(slots: DataFrame, bits: int) -> Broadcast:
    """Broadcast of ``bits`` bits (a power of two of at least 2**15) with those in ``slots(h)`` set, 0 <= h < bits."""
    parts = slots.groupBy(F.shiftright("h", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("h").bitwiseAND(F.lit(_PART - 1))).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for row in parts:
        at = int(row["part"]) * (_PART // 8)
        out[at : at + _PART // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return slots.sparkSession.sparkContext.broadcast(out)


def is_set(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (bitmap[h >> 3] >> (h & 7) & 1).astype(bool)
