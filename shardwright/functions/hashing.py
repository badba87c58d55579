"""Seeded, engine-independent randomness from MD5.

Every random choice of the library (file shuffles, row shuffles, splits,
language draws, mixture clocks) is a pure function of ``(seed, key)``, so a
re-run, a retried task or another engine gives the same answer.

Fixed conventions (the DuckDB oracle uses the same formulas):
- order key: ``md5(seed || ':' || key)``, ties broken by the key itself;
- uniform in (0, 1): the first 13 hex digits of the MD5 (52 bits) as an
  integer ``h``, then ``(h + 1) / (2**52 + 1)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIFORM_DENOM = 4503599627370497.0  # 2**52 + 1


def _str(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def order_key(seed, key) -> Column:
    """``md5('<seed>:<key>')`` as a hex string."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _str(key)))


def hash52(hexcol: Column) -> Column:
    """First 52 bits of a hex digest as a bigint."""
    return F.conv(F.substring(hexcol, 1, 13), 16, 10).cast("bigint")


def uniform(seed, key) -> Column:
    """Uniform double in (0, 1) from ``(seed, key)``."""
    return (hash52(order_key(seed, key)) + F.lit(1)).cast("double") / F.lit(UNIFORM_DENOM)
