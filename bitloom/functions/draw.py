"""Draws that depend on a seed and a key only, not on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) for each key."""
    return F.pmod(F.xxhash64(F.lit(seed).cast("long"), *(k.cast("long") for k in keys)), F.lit(1 << 53).cast("long")).cast("double") / float(1 << 53)


def uniform_of(seed: int, *keys: int) -> float:
    """The same number for plain integers."""
    import xxhash

    h = 42
    for v in (seed, *keys):
        h = xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), seed=h)
    return (h % (1 << 53)) / float(1 << 53)
