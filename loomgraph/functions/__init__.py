"""Column functions: derived weights and hash-based uniform numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_WEIGHT = 10_000


def derived_weight(src: Column, dst: Column, seed: int = 0) -> Column:
    """A weight in 1..10000 that depends on the edge and the seed only, so reruns agree."""
    return (F.pmod(F.xxhash64(src, dst, F.lit(seed)), F.lit(MAX_WEIGHT)) + 1).cast("long")


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) from the 53 high bits of a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * F.lit(2.0**-53)


def log2_up(n: int) -> int:
    """The least k with 2**k >= n."""
    return max(0, int(n - 1).bit_length())
