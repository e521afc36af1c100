"""Combining votes and model scores."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_of(columns: list[Column]) -> Column:
    """Plain mean of a fixed list of columns, added from left to right."""
    return reduce(add, columns) / F.lit(float(len(columns)))


def ensemble(delayed: Column, feedback: Column) -> Column:
    """Half delayed, half feedback; delayed alone while no feedback model answers (below 0)."""
    return F.when(feedback >= 0, F.lit(0.5) * delayed + F.lit(0.5) * feedback).otherwise(delayed)
