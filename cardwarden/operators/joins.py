"""Joins that stay safe when one key holds a large share of all rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NULL_KEY_SALTS = 1024


def fits_broadcast(df: DataFrame, max_rows: int) -> bool:
    """Count at most ``max_rows + 1`` rows to learn whether the frame may be broadcast."""
    return df.limit(max_rows + 1).count() <= max_rows


def hot_keys(counts: DataFrame, keys: list[str], rows_col: str, hot_rows: int, max_keys: int):
    """Keys with more than ``hot_rows`` rows and the number of salts each needs, or None.

    ``counts`` has one row per key, on a table that is cheap to read twice. Were there ever more
    hot keys than may be broadcast, the limit for being hot rises until they fit: that changes
    how rows spread over tasks, never which rows join.
    """
    limit = hot_rows
    while True:
        hot = counts.where(F.col(rows_col) > limit)
        found = hot.limit(max_keys + 1).count()
        if found == 0:
            return None
        if found <= max_keys:
            return hot.select(*keys, F.ceil(F.col(rows_col) / limit).cast("int").alias("_salts"))
        limit *= 4


def spread_join(
    rows: DataFrame,
    groups: DataFrame,
    keys: list[str],
    id_col: str,
    hot: DataFrame | None,
    how: str = "left",
) -> DataFrame:
    """Join many ``rows`` to ``groups`` (one row per key) with the hot keys salted.

    Only the group rows of hot keys are repeated, once per salt; ``hot`` is bounded by
    :func:`hot_keys`. Rows with a null key match nothing and are dealt out evenly.
    """
    if hot is None:
        return rows.join(groups, keys, how)
    small = F.broadcast(hot)
    dealt = F.xxhash64(id_col)
    no_key = reduce(or_, [F.col(k).isNull() for k in keys])
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = (
        rows.join(small, keys, "left")
        .withColumn(
            "_salt",
            F.when(no_key, F.pmod(dealt, F.lit(_NULL_KEY_SALTS))).otherwise(F.pmod(dealt, salts)),
        )
        .drop("_salts")
    )
    right = (
        groups.join(small, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
