"""Text lines to parsed transactions and rejects."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwarden.config import EngineConfig
from cardwarden.functions import text
from cardwarden.operators.encode import ID_VARIABLES, RISK_VARIABLES

# Fields whose text is looked up in the dictionary later.
LEVELS = [*RISK_VARIABLES, *ID_VARIABLES]


@lru_cache(maxsize=8)
def _columns(jvm, default_amount: float, default_age: int) -> tuple[Column, Column, dict[str, Column]]:
    """The split line, its time, and the other columns. Made once for a JVM: hundreds of calls to it."""
    # Exploding a one-element array keeps the split a step of its own: a later filter on the
    # reject reason would otherwise be pushed below it and split every line again.
    split = F.explode(F.array(text.split_quoted(F.col("value"))))
    field = {name: F.get("_f", F.lit(i)) for i, name in enumerate(text.RAW_FIELDS)}
    bare = {name: text.without_quotes(col) for name, col in field.items()}
    arity_ok = F.size("_f") == len(text.RAW_FIELDS)
    return split, text.datetime_or_null(bare["tx_datetime"]), {
        "reject_reason": F.when(F.coalesce(~arity_ok, F.lit(True)), F.lit("arity")).when(
            F.col("tx_datetime").isNull(), F.lit("datetime")
        ),
        "cardid": text.card_id(field["cardid"]),
        "tx_amount": text.float_or(field["tx_amount"], default_amount),
        "boo1": text.bool_or(bare["boo1"], True),
        "boo2": text.bool_or(bare["boo2"], True),
        "age": text.int_or(bare["age"], default_age),
        "label": text.bool_or(field["label"], False),
        **{f"{name}_level": bare[name] for name in LEVELS},
    }


def parse_lines(lines: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Add typed columns and ``reject_reason`` (null for a good row) to a ``value`` column.

    A narrow projection: one pass over the lines, no shuffle, valid on a stream too.
    """
    split, time, rest = _columns(lines.sparkSession._jvm, cfg.default_amount, cfg.default_age)
    return lines.withColumn("_f", split).withColumn("tx_datetime", time).withColumns(rest).drop("_f")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject_reason IS NULL").drop("value", "reject_reason")


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject_reason IS NOT NULL").select(
        *[c for c in ("tx_id", "value", "reject_reason") if c in parsed.columns]
    )
