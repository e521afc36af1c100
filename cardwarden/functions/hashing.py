"""Stable buckets: the same id lands in the same bucket on any layout and any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(id_col: Column, n: Column | int, offset: int = 1) -> Column:
    """Bucket in ``0 … n-1`` from seven hex digits of the id's md5, starting at ``offset``."""
    digits = F.substring(F.md5(id_col.cast("string").cast("binary")), offset, 7)
    count = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), count.cast("bigint")).cast("int")
