"""Bitmaps of fixed size over 64-bit numbers.

A bitmap says of a number either "not in the set" or "perhaps": a cheap filter
before an exact step.  Its size does not depend on the data, so it may be
collected and broadcast; a crowded one filters less and loses nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 64-bit words of a bitmap: 8 MB, at most 2 ** 20 small rows to the driver.
SLOTS = 1 << 20


def bitmap(numbers: DataFrame, column: str) -> np.ndarray:
    """Bitmap of a column of longs."""
    found = (numbers.select(
        F.shiftrightunsigned(column, 6).bitwiseAND(F.lit(SLOTS - 1)).alias("slot"),
        F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))").alias("bit"))
        .groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(SLOTS, dtype=np.uint64)
    out[found["slot"].to_numpy()] = found["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def perhaps(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which of the numbers may be in the set."""
    slot = ((numbers >> np.uint64(6)) & np.uint64(SLOTS - 1)).astype(np.int64)
    return (bits[slot] >> (numbers & np.uint64(63))) & np.uint64(1) == 1
