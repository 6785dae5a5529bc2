"""A bitmap of fixed size over 64-bit hashes, to let a scan skip what can't match."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 24  # 2 MB, whatever the number of hashes; a fuller bitmap only lets more pass


def bitmap_of(hashes: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Words of the bitmap; at most ``2 ** bits / 64`` rows reach the driver."""
    bit = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = (
        hashes.select(bit.alias("b"))
        .groupBy(F.shiftright("b", 6).alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, int(b & 63)))").alias("m"))
    ).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words["w"].to_numpy()] = words["m"].to_numpy().view(np.uint64)
    return out


def passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (unsigned) may be in the set."""
    bit = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
