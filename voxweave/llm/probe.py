"""Fixed-size bitmaps of hash columns: a filter for a scan whose size does not depend on the data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmap(df: DataFrame, hash64: Column, bits: int = 22) -> np.ndarray:
    """Bitmap of 2**bits bits over the low bits of a 64-bit hash. At most 2**bits / 64 rows reach the driver. A full
    bitmap lets everything pass, so exact joins must follow."""
    low = hash64.bitwiseAND(F.lit((1 << bits) - 1))
    words = (df.select(F.shiftright(low, 6).alias("word"), low.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
             .groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask")))
    out = np.zeros(1 << (bits - 6), np.int64)
    for row in words.collect():
        out[row["word"]] = row["mask"]
    return out.view(np.uint64)


def probe(found: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the bitmap."""
    low = hashes & np.uint64(64 * len(found) - 1)
    return (found[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) == 1
