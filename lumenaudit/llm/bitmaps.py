"""Sets of hashed keys as bitmaps of one fixed size: a superset that tasks can ask before they shuffle anything."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap (4 MB): what is broadcast has this size however large the set is. In a full set it lets all pass; results do not depend on it.
BITS = 25
_BUCKET = 32_768


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit key of two 64-bit fingerprints; pair_column() is the same in Spark."""
    return a ^ ((b >> np.uint64(7)) | (b << np.uint64(57)))


def pair_column(a: str, b: str) -> Column:
    return F.col(a).bitwiseXOR(F.shiftrightunsigned(b, 7).bitwiseOR(F.shiftleft(b, 57)))


def bitmap(keys: DataFrame, key: Column, bits: int = BITS) -> np.ndarray:
    """Bitmap of the leading bits of the keys, built in parts by Spark; at most 2**bits bits reach the driver."""
    x = F.shiftrightunsigned(key, 64 - bits) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(x).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits"))
    out = np.zeros(((1 << bits) + 7) // 8, np.uint8)
    for row in parts.toLocalIterator():
        at = (row.part - 1) * (_BUCKET // 8)
        out[at : at + len(row.bits)] = np.frombuffer(row.bits, np.uint8)[: len(out) - at]
    return out


def may_hold(bitmap: np.ndarray, keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    at = keys >> np.uint64(64 - bits)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
