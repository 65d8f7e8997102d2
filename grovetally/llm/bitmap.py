"""Sets of 64-bit hashes as bitmaps of a fixed size: may say yes too often, never no wrongly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(frame: DataFrame, column: str, bits: int) -> np.ndarray:
    """The bitmap of a long column; at most 2**(bits - 6) words reach the driver."""
    spot = F.shiftrightunsigned(column, 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int"))
    filled = frame.select(F.shiftright(spot, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[filled["word"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    return out


def test(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = len(bitmap).bit_length() + 5
    place = hashes >> np.uint64(64 - bits)
    return ((bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
