"""Hours and days counted from the stream origin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS


def elapsed(ts: Column, origin_ms: Column | int, unit_ms: int) -> Column:
    """Whole units since the origin, truncated toward zero."""
    origin = F.lit(origin_ms) if isinstance(origin_ms, int) else origin_ms
    gap = F.unix_millis(ts) - origin
    return F.call_function("div", gap, F.lit(unit_ms)).cast("int")


def relative_hour(ts: Column, origin_ms: Column | int) -> Column:
    return elapsed(ts, origin_ms, HOUR_MS)


def with_time_fields(df, origin_ms: Column | int):
    """Add the relative hour, the hour of day and the day of week (Sunday is 1)."""
    return df.withColumns(
        {
            "tx_dhour": relative_hour(F.col("tx_datetime"), origin_ms),
            "tx_hour": F.hour("tx_datetime"),
            "tx_dayw": F.dayofweek("tx_datetime"),
        }
    )
