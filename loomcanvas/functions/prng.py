"""A counter-based random number: a hash of (seed, key, step, channel), the same in any engine and any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*parts: Column | str | int) -> Column:
    """An integer in [0, 2**32) from the first eight hex digits of md5 of the parts joined by ``|``."""
    joined = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    return draw(*parts) / F.lit(4294967296.0)
