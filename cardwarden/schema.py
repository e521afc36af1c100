"""Column lists and nominal domains shared by batch and stream."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HISTORY_KEY = ["tx_dhour", "tx_datetime", "cardid"]

# The feature vector in slot order.
FEATURES = [
    "age", "cat3", "cat4", "gender", "nationality",
    "last_merchantarea", "last_merchant", "last_cat2", "last_cat1",
    "merchantarea", "merchant", "cat2", "cat1", "boo2", "boo1",
    "tx_amount", "tx_dayw", "tx_hour",
    "w1_avg_amount", "w1_avg_merchantarea", "w1_count_amount", "w1_count_merchantarea",
    "w1_max_amount", "w1_max_merchantarea", "w1_min_amount", "w1_min_merchantarea",
    "w1_mmdif_amount", "w1_mmdif_merchantarea", "w1_countboo1false",
    "w1_sum_amount", "w1_sum_merchantarea",
]

# Least number of codes of each nominal feature; codes run from 0.
NOMINAL_ARITY = {"cat3": 7, "cat4": 7, "gender": 3, "nationality": 20, "boo1": 2, "boo2": 2}

# Class names in code order.
LABELS = ["genuine", "fraud"]

# Names of the card statistics and scores.
AMOUNT_STATS = [
    "w1_min_amount", "w1_max_amount", "w1_mmdif_amount", "w1_sum_amount",
    "w1_count_amount", "w1_avg_amount", "w1_countboo1false",
]
AREA_STATS = [
    "w1_min_merchantarea", "w1_max_merchantarea", "w1_mmdif_merchantarea",
    "w1_sum_merchantarea", "w1_count_merchantarea", "w1_avg_merchantarea",
]
LAST_TX = ["last_merchantarea", "last_cat1", "last_cat2", "last_merchant"]
SCORES = ["zfraud_pr", "zfraud_pr_d", "zfraud_pr_f"]


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


TX_FEATURES = T.StructType(
    _struct(
        cardid=T.StringType(), cat1=T.DoubleType(), cat2=T.DoubleType(),
        merchant=T.DoubleType(), merchantarea=T.DoubleType(), tx_amount=T.DoubleType(),
        tx_datetime=T.TimestampType(), tx_dhour=T.IntegerType(), tx_hour=T.IntegerType(),
        tx_dayw=T.IntegerType(), boo1=T.BooleanType(), boo2=T.BooleanType(),
        age=T.IntegerType(), nationality=T.IntegerType(), gender=T.IntegerType(),
        cat3=T.IntegerType(), cat4=T.IntegerType(), label=T.BooleanType(),
    ).fields
    + [
        T.StructField(c, T.IntegerType() if c == "w1_countboo1false" else T.DoubleType())
        for c in AMOUNT_STATS + AREA_STATS + LAST_TX
    ]
)
TX_SCORED = T.StructType(TX_FEATURES.fields + [T.StructField(c, T.DoubleType()) for c in SCORES])
# The stored history adds an id for tie-breaks and bags, and the batch that wrote the row.
TX_STORED = T.StructType(
    [T.StructField("tx_id", T.LongType())]
    + TX_SCORED.fields
    + [T.StructField("batch_id", T.LongType())]
)
ALERT = T.StructType([T.StructField("tx_rank", T.IntegerType()), *TX_STORED.fields[:-1]])


#: Features are cut to plus or minus this when they enter a vector.
LARGEST_FEATURE = 1e15


def nominal_metadata(values: list[str]) -> dict:
    return {"ml_attr": {"type": "nominal", "vals": values}}


def feature_column(name: str, alias: str, arity: Mapping[str, int] = NOMINAL_ARITY) -> Column:
    """A feature as double; nominal ones carry their domain, and codes outside it become 0.

    Fits refuse numbers that are not finite, so NaN enters as 0 and infinities, like anything
    beyond ``LARGEST_FEATURE``, as that bound; the stored row keeps the number it came with.
    """
    col = F.col(name)
    codes = arity.get(name)
    if codes is None:
        number = col.cast("double")
        bounded = F.greatest(F.lit(-LARGEST_FEATURE), F.least(F.lit(LARGEST_FEATURE), number))
        return F.when(F.isnan(number), F.lit(0.0)).when(number.isNotNull(), bounded).alias(alias)
    code = col.cast("int")
    inside = F.when((code >= 0) & (code < codes), code).otherwise(F.lit(0))
    vals = [str(i) for i in range(codes)]
    return inside.cast("double").alias(alias, metadata=nominal_metadata(vals))


def class_column() -> Column:
    """The label as double, with both class names even if the data hold only one of them."""
    code = F.col("label").cast("int").cast("double")
    return code.alias("class", metadata=nominal_metadata(LABELS))


def typed(df: DataFrame, schema: T.StructType, extra: tuple[str, ...] = ()) -> DataFrame:
    """Project ``df`` onto ``schema`` by name, with its types; ``extra`` columns ride along."""
    names = {f.name for f in schema.fields}
    casts = [f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema.fields]
    return df.selectExpr(*[c for c in extra if c not in names], *casts)
