"""Seeded draws that depend only on their keys.

``rand(seed)`` changes with the partitioning and is drawn again when a stage is
retried. These draws hash the keys instead, so a lost executor, another number of
partitions or another SQL engine gives the same value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
SPAN = 4294967296.0


def _text(key) -> Column:
    return (key if isinstance(key, Column) else F.lit(key)).cast("string")


def digest(*keys, seed: int = SEED) -> Column:
    """md5 of the seed and the keys, as 32 hexadecimal signs."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_text(k) for k in keys]))


def hash32(*keys, seed: int = SEED) -> Column:
    """A whole number in [0, 2**32)."""
    return F.conv(F.substring(digest(*keys, seed=seed), 1, 8), 16, 10).cast("bigint")


def uniform(*keys, seed: int = SEED) -> Column:
    """A double in [0, 1)."""
    return hash32(*keys, seed=seed) / F.lit(SPAN)


def integer(n, *keys, seed: int = SEED) -> Column:
    """A whole number in [0, n); ``n`` may be a column."""
    return F.floor(uniform(*keys, seed=seed) * n).cast("bigint")
