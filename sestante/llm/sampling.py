"""Bounded samples for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sampled(rows: DataFrame, limit: int, *keys: str) -> DataFrame:
    """At most ``limit`` rows, those with the least hash of ``keys``.

    Where there are many more, rows far from the least hashes are dropped first, so that what the tasks together send
    on stays about twice the sample, whatever their number.
    """
    h = F.xxhash64(*keys)
    n = rows.count()
    if n > 4 * limit:
        rows = rows.where(F.shiftrightunsigned(h, 11) < int(2 * limit / n * 2**53))
    return rows.orderBy(F.shiftrightunsigned(h, 11), *keys).limit(limit)
