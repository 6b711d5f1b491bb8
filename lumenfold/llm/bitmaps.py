"""A set of 64-bit hashes as a bitmap of bounded size: it admits every member, and few others while it is sparse."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: bits of one bitmap of Spark's bitmap functions.
BUCKET_BITS = 1 << 15
#: 16 MB at most, whatever the number of keys.
MOST_BITS = 1 << 27
BITS_A_KEY = 32


@dataclass
class Bitmap:
    data: bytes
    size: int

    def admits(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes.view("<u8") & np.uint64(self.size - 1)).astype(np.int64)
        return (np.frombuffer(self.data, np.uint8)[at >> 3] >> (at & 7)) & 1 == 1


def bitmap_of(keys: DataFrame, column: str) -> Bitmap:
    """Built on the executors; what reaches the driver is the bitmap, at most MOST_BITS, in one job."""
    size = min(MOST_BITS, max(BUCKET_BITS, 1 << (BITS_A_KEY * keys.count()).bit_length()))
    bit = F.pmod(F.col(column), F.lit(size)) + 1  # Spark counts bitmap buckets from 1
    rows = keys.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    data = np.zeros((size // BUCKET_BITS, BUCKET_BITS // 8), np.uint8)
    found = rows.toArrow()
    for bucket, bits in zip(found.column("bucket").to_pylist(), found.column("bits"), strict=True):
        data[bucket - 1] = np.frombuffer(bits.as_buffer(), np.uint8)
    return Bitmap(data.tobytes(), size)
