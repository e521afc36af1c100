"""Turning one text line into typed columns. Every function returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field order of a transaction line.
RAW_FIELDS = [
    "cardid", "cat1", "cat2", "merchant", "merchantarea", "tx_amount", "tx_datetime",
    "boo1", "boo2", "age", "nationality", "gender", "cat3", "cat4", "label",
]
# Time format of the input lines; parts may have one digit, text may follow.
DATETIME_FORMAT = "yyyy-M-d H:m:s"
_DATETIME = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}"

# A Unicode noncharacter that leads two-character marks: 0 after it stands for itself in the
# line, 1 for a separating comma. So lines that hold the character split like any other.
_MARK = "\uffff"


def split_quoted(value: Column) -> Column:
    """Split on commas that an even number of quotes follows; trailing empty fields stay.

    Cutting at the quotes first is linear in the line, whatever its number of quotes.
    """
    kept = F.replace(value, F.lit(_MARK), F.lit(_MARK + "0"))
    from_end = F.transform(
        F.reverse(F.split(kept, '"', -1)),
        lambda piece, i: F.when(
            i % 2 == 0, F.replace(piece, F.lit(","), F.lit(_MARK + "1"))
        ).otherwise(piece),
    )
    fields = F.split(F.array_join(F.reverse(from_end), '"'), _MARK + "1", -1)
    return F.transform(fields, lambda f: F.replace(f, F.lit(_MARK + "0"), F.lit(_MARK)))


def without_quotes(field: Column) -> Column:
    return F.replace(field, F.lit('"'), F.lit(""))


def card_id(field: Column) -> Column:
    """Quotes removed, then blanks and control characters cut from both ends."""
    return F.regexp_replace(without_quotes(field), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def float_or(field: Column, default: float) -> Column:
    """Number or default. Spark's cast also reads 'inf' and 'nan' in any case; those are text here."""
    loose = field.rlike(r"(?i)^\s*[+-]?(inf|infinity|nan)\s*$") & ~field.rlike(
        r"^\s*[+-]?(Infinity|NaN)\s*$"
    )
    return F.when(loose, F.lit(default)).otherwise(
        F.coalesce(field.try_cast("double"), F.lit(default))
    )


def int_or(field: Column, default: int) -> Column:
    strict = F.when(field.rlike(r"^[+-]?\d+$"), field.try_cast("int"))
    return F.coalesce(strict, F.lit(default))


def bool_or(field: Column, default: bool) -> Column:
    word = F.lower(field)
    return (
        F.when(word == "true", F.lit(True))
        .when(word == "false", F.lit(False))
        .otherwise(F.lit(default))
    )


def datetime_or_null(field: Column) -> Column:
    """The time at the start of the field. Months, hours and so on beyond their range make it
    null: such a line is rejected, never moved to another day."""
    return F.try_to_timestamp(F.regexp_extract(field, _DATETIME, 0), F.lit(DATETIME_FORMAT))
