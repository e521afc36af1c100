"""Transactions, dictionary and raw lines derived from the ``events`` table, over all its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwarden.config import EngineConfig
from cardwarden.operators.encode import Dictionary, encode_risk
from cardwarden.session import materialize

CFG = EngineConfig()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed transactions before encoding."""
    return spark.sql(
        """
        SELECT event_id AS tx_id, CAST(user_id AS STRING) AS cardid, k,
          event_type AS cat1_level, 'c' || CAST(k % 5 AS STRING) AS cat2_level,
          'm' || CAST(k AS STRING) AS merchant_level,
          'a,' || CAST(k DIV 10 AS STRING) AS merchantarea_level,
          value AS tx_amount, date_trunc('second', ts) AS tx_datetime,
          event_type <> 'view' AS boo1, event_id % 2 = 0 AS boo2,
          CAST(18 + user_id % 60 AS INT) AS age, CAST(user_id % 20 AS INT) AS nationality,
          CAST(user_id % 3 AS INT) AS gender, CAST(k % 7 AS INT) AS cat3,
          CAST(event_id % 7 AS INT) AS cat4, event_type = 'error' AND value >= 100 AS label,
          CAST((unix_millis(date_trunc('second', ts))
            - (SELECT min(unix_millis(date_trunc('second', ts))) FROM {ev})) DIV 3600000 AS INT)
            AS tx_dhour,
          hour(ts) AS tx_hour, dayofweek(ts) AS tx_dayw
        FROM {ev}
        """,
        ev=events(spark, sf_dir),
    )


def origin_ms(rows: DataFrame) -> int:
    """The stream origin: the earliest transaction time."""
    return rows.agg(F.min(F.unix_millis("tx_datetime"))).first()[0]


def dictionary_entries(rows: DataFrame) -> DataFrame:
    """One entry per variable and level; a single pass over the transactions."""
    risk_levels = F.array(
        *[
            F.struct(F.lit(variable).alias("variable"), F.lit(0).alias("id"), F.col(col).alias("level"))
            for variable, col in (
                ("cat1", "cat1_level"),
                ("cat2", "cat2_level"),
                ("merchant", "merchant_level"),
                ("TERM_COUNTRY", "merchantarea_level"),
            )
        ],
        *[
            F.struct(
                F.lit(variable).alias("variable"),
                F.col(col).alias("id"),
                F.concat(F.lit(prefix), F.col(col).cast("string")).alias("level"),
            )
            for variable, col, prefix in (
                ("nationality", "nationality", "n"),
                ("GENDER", "gender", "g"),
                ("cat3", "cat3", "t"),
                ("cat4", "cat4", "u"),
            )
        ],
    )
    coded = F.col("variable").isin("nationality", "GENDER", "cat3", "cat4")
    return (
        rows.select(F.inline(risk_levels), F.col("label").cast("int").alias("fraud"))
        .groupBy("variable", "id", "level")
        .agg(F.round(F.avg("fraud"), 6).alias("risk"))
        .withColumn("risk", F.when(coded, F.lit(0.0)).otherwise(F.col("risk")))
    )


def dictionary(rows: DataFrame) -> Dictionary:
    return Dictionary.of(materialize(dictionary_entries(rows), "dictionary"), CFG)


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with risk-coded categories."""
    rows = tx(spark, sf_dir)
    return encode_risk(rows, dictionary(rows), CFG).drop("k")


def raw_lines(rows: DataFrame) -> DataFrame:
    """The 15-field text lines of all transactions, with planted defects."""
    return rows.sparkSession.sql(
        """
        SELECT tx_id, tx_dhour, '"' || cardid || ' ",' || cat1_level || ',' || cat2_level || ',' ||
          CASE WHEN tx_id % 71 = 0 THEN 'zzz' ELSE merchant_level END || ',"' ||
          merchantarea_level || '",' ||
          CASE WHEN tx_id % 83 = 0 THEN 'abc' ELSE CAST(tx_amount AS STRING) END || ',"' ||
          CASE WHEN tx_id % 89 = 0 THEN 'bad'
               ELSE date_format(tx_datetime, 'yyyy-MM-dd HH:mm:ss') END || '",' ||
          CASE WHEN tx_id % 73 = 0 THEN 'yes' WHEN boo1 THEN 'true' ELSE 'false' END || ',' ||
          CASE WHEN boo2 THEN 'TRUE' ELSE 'False' END || ',' ||
          CASE WHEN tx_id % 79 = 0 THEN '4x' ELSE CAST(age AS STRING) END ||
          ',n' || CAST(nationality AS STRING) || ',g' || CAST(gender AS STRING) ||
          ',t' || CAST(cat3 AS STRING) || ',u' || CAST(cat4 AS STRING) || ',' ||
          CASE WHEN label THEN 'true' ELSE 'false' END ||
          CASE WHEN tx_id % 97 = 0 THEN ',extra' ELSE '' END AS value
        FROM {tx}
        """,
        tx=rows,
    )


def scored(rows: DataFrame) -> DataFrame:
    """Transactions with made-up but fixed scores, for exact checks of alerts and ensembles."""
    return rows.sparkSession.sql(
        """
        SELECT tx_id, cardid, tx_datetime, tx_dhour, tx_dhour DIV 24 AS day_no, label, tx_amount,
          CAST(tx_id * 37 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS pd,
          CASE WHEN tx_dhour < 192 THEN CAST(-1 AS DOUBLE)
               ELSE CAST(tx_id * 91 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS pf
        FROM {tx}
        """,
        tx=rows,
    )
