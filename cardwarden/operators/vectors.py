"""Typed rows to feature vectors; one definition for live and stored rows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import lru_cache

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwarden.schema import FEATURES, NOMINAL_ARITY, class_column, feature_column

_PREFIX = "_x_"


@lru_cache(maxsize=8)
def _parts(jvm, arity: tuple[tuple[str, int], ...]) -> tuple[dict[str, Column], VectorAssembler]:
    """The numbers of all slots and their assembler. Made once for a JVM: hundreds of calls to it."""
    codes = dict(arity)
    parts = {f"{_PREFIX}{name}": feature_column(name, f"{_PREFIX}{name}", codes) for name in FEATURES}
    return parts, VectorAssembler(inputCols=list(parts), outputCol="features", handleInvalid="keep")


def with_vector(
    df: DataFrame, label: bool = False, arity: Mapping[str, int] = NOMINAL_ARITY
) -> DataFrame:
    """Add ``features`` (and ``class``); nominal features keep their domain as metadata."""
    parts, assembler = _parts(df.sparkSession._jvm, tuple(sorted(arity.items())))
    out = assembler.transform(df.select("*", *parts.values())).drop(*parts)
    return out.select("*", class_column()) if label else out


def vector_columns(df: DataFrame) -> list:
    """The slots of ``features`` as named columns."""
    slots = vector_to_array(F.col("features"))
    return [slots[i].alias(name) for i, name in enumerate(FEATURES)]
