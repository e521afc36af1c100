"""Streaming and static readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwarden.config import EngineConfig
from cardwarden.functions.text import split_quoted, without_quotes
from cardwarden.operators.encode import Dictionary


def source_options(kind: str, cfg: EngineConfig) -> dict[str, str]:
    """Rate limit and start of ``cfg`` as options of a source.

    Kafka starts each partition at its first message of ``start_ms`` or later, and at its end if it
    has none; restarts go on from the stream's checkpoint. A folder's start is a condition on rows.
    """
    options = {}
    if kind == "kafka":
        options["startingOffsets"] = "earliest"
        if cfg.start_ms is not None:
            options["startingTimestamp"] = str(cfg.start_ms)
            options["startingOffsetsByTimestampStrategy"] = "latest"
    if cfg.max_per_trigger is not None:
        limit = "maxOffsetsPerTrigger" if kind == "kafka" else "maxFilesPerTrigger"
        options[limit] = str(cfg.max_per_trigger)
    return options


def read_transactions(
    spark: SparkSession, kind: str, options: dict[str, str], path=None, cfg: EngineConfig = EngineConfig()
):
    """A stream of lines in ``value``, with a stable ``tx_id``.

    ``kind`` is any line source: ``kafka`` (with its servers and ``subscribe`` topic in the
    options; the message key is not used) or ``text`` (a folder). Kafka needs Spark's Kafka
    package on the class path. The rate limit and start of ``cfg`` hold for both; ``options``
    given here win.
    """
    lines = spark.readStream.format(kind).options(**{**source_options(kind, cfg), **options}).load(path)
    if kind != "kafka" and cfg.start_ms is not None:
        arrived = F.unix_millis(F.col("_metadata.file_modification_time"))
        lines = lines.where(arrived >= cfg.start_ms)
    return lines.select(F.col("value").cast("string").alias("value")).withColumn(
        "tx_id", F.xxhash64("value")
    )


def parse_dictionary(lines: DataFrame) -> DataFrame:
    """Dictionary lines (``value``, ``line_no``) to entries; the first line of a level counts."""
    fields = lines.select("line_no", split_quoted(F.col("value")).alias("f"))
    item = lambda i: without_quotes(F.get("f", F.lit(i)))
    first = F.min_by(F.struct("id", "risk"), "line_no").alias("e")
    return (
        fields.select(
            "line_no",
            item(0).alias("variable"),
            item(1).try_cast("int").alias("id"),
            item(2).alias("level"),
            item(3).try_cast("double").alias("risk"),
        )
        .where("variable IS NOT NULL AND level IS NOT NULL")
        .groupBy("variable", "level")
        .agg(first)
        .select("variable", "level", "e.id", "e.risk")
    )


def read_dictionary(spark: SparkSession, path: str, cfg: EngineConfig) -> Dictionary:
    """Read a dictionary file. Lines are ordered by file, block and position in the block."""
    lines = spark.read.text(path).select(
        "value",
        F.struct(
            "_metadata.file_path",
            "_metadata.file_block_start",
            F.monotonically_increasing_id().alias("at"),
        ).alias("line_no"),
    )
    return Dictionary.of(parse_dictionary(lines).persist(), cfg)
