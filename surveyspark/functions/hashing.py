"""Deterministic randomness: md5 of (key, seed), the same on every engine.

A shuffle of keys is an ordering by ``hash_key``; a uniform draw is
``uniform(hash_key(...))``. Neither depends on partitioning, so a lost executor
that recomputes a partition draws the same values again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13
UNIFORM_SPAN = 16**HEX_DIGITS


def hash_key(*parts: Column | str | int) -> Column:
    """md5 hex of the parts joined by ':'; str names a column, int is a literal."""
    columns = [
        p.cast("string") if isinstance(p, Column)
        else F.lit(str(p)) if isinstance(p, int)
        else F.col(p).cast("string")
        for p in parts
    ]
    return F.md5(F.concat_ws(":", *columns))


def hash_integer(hexed: Column, digits: int = HEX_DIGITS) -> Column:
    """Leading hex digits as a long; at most 15 so the value stays positive."""
    return F.conv(F.substring(hexed, 1, digits), 16, 10).cast("long")


def uniform(hexed: Column) -> Column:
    """Uniform double in [0, 1) from a hash."""
    return hash_integer(hexed).cast("double") / F.lit(float(UNIFORM_SPAN))
