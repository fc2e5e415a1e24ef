"""Deterministic choices derived from row keys.

Every random decision (sampling, shuffling, noise draws, gain jitter) hashes the row key with a
seed, so results do not depend on partitioning, retries or the number of executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 1 << 60


def md5_key(seed, *cols: Column) -> Column:
    """Hex digest of ``seed:col:col...``; the shuffle and sampling order of a row."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash60(seed, *cols: Column) -> Column:
    """The first 60 digest bits as a non-negative BIGINT."""
    return F.conv(F.substring(md5_key(seed, *cols), 1, 15), 16, 10).cast("bigint")


def pick(n, seed, *cols: Column) -> Column:
    """A uniform integer in ``[0, n)``; ``n`` may be a column."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(hash60(seed, *cols), n.cast("bigint"))


def uniform(low: float, high: float, seed, *cols: Column) -> Column:
    """A uniform double in ``[low, high)``."""
    share = hash60(seed, *cols).cast("double") / F.lit(float(HASH_RANGE))
    return F.lit(float(low)) + F.lit(float(high - low)) * share
