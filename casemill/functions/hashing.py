"""Reproducible pseudo-random columns.

Every random choice is a function of (seed, row id), so a retried task or a lost
executor reproduces the same rows, and another engine can check the result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*parts) -> Column:
    """First 32 bits of ``md5(part:part:...)`` as a non-negative long."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """Uniform double in [0, 1)."""
    return hash32(*parts) / F.lit(4294967296.0)
