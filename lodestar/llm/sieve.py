"""A bitmap of fixed size that tells which keys are worth a second look."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Sieve:
    """Which keys may be shared: one bit for each of 2^26 hashes, 8 MB whatever the corpus.

    It spares most keys the second shuffle.  When it fills up it lets more keys pass, which
    the join with the shared keys then drops.
    """

    BITS = 1 << 26

    def __init__(self, shared: DataFrame):
        spot = F.pmod(F.col("key"), F.lit(self.BITS))
        rows = shared.groupBy(F.bitmap_bucket_number(spot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits")).collect()
        width = 4096
        bits = np.zeros((self.BITS // (8 * width) + 2) * width, dtype=np.uint8)
        for r in rows:
            bits[r["bucket"] * width : (r["bucket"] + 1) * width] |= np.frombuffer(bytes(r["bits"]), np.uint8)
        self.bits = bits

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """Bucket and position are those of Spark's bitmap functions: position p > 0 is bit p - 1, from bucket 1 on."""
        p = np.mod(keys, self.BITS)
        bucket, at = np.where(p > 0, 1 + (p - 1) // 32768, 0), np.where(p > 0, (p - 1) % 32768, 0)
        return (self.bits[bucket * 4096 + at // 8] >> (at % 8).astype(np.uint8)) & 1 > 0
