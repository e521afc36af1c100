"""Feeding the whole transaction table to the stream engine, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwarden.config import EngineConfig
from cardwarden.plans import fixtures as fx
from cardwarden.session import beside, scratch_path
from cardwarden.sources.tables import Tables
from cardwarden.streaming.engine import Engine

#: Hours of a replayed batch: two batches a day, so lists of a day's alerts are merged.
BATCH_HOURS = 12
#: Hours of a batch of the run whose tables are read back: as long as history is kept.
STORED_HOURS = 120

#: Lines of a file at most: small enough that a large batch is parsed and scored by many tasks.
FILE_LINES = 20_000

_RUNS: dict[tuple[str, str], str] = {}


def write_batches(lines: DataFrame, batch: str, path: str) -> list[int]:
    """Write lines (``tx_id``, ``value``) once, one folder per batch; the batches in order.

    A crowded batch is split over tasks and files, small ones share a task. Files are bounded by
    lines, since the engine's work on a line is large beside its bytes.
    """
    spark = lines.sparkSession
    parts = lines.select("tx_id", "value", F.col(batch).alias("part")).hint("rebalance", "part")
    parts.write.option("maxRecordsPerFile", FILE_LINES).partitionBy("part").parquet(path)
    found = spark.read.parquet(path).select("part").distinct().orderBy("part").collect()
    return [row["part"] for row in found]


def replay(spark: SparkSession, sf_dir: str, cfg: EngineConfig, hours_per_batch: int = BATCH_HOURS) -> Tables:
    """Run the engine over all transactions, one batch after the other, and return its tables."""
    rows = fx.tx(spark, sf_dir)
    part = F.call_function("div", F.col("tx_dhour"), F.lit(hours_per_batch)).alias("part")
    source, root = scratch_path(spark, "lines"), scratch_path(spark, "engine")
    lines = fx.raw_lines(rows).withColumn("part", part)
    with beside(spark, write_batches, lines, "part", source) as written:
        dictionary = fx.dictionary(rows)
    batches = written.result()
    engine = Engine(Tables(spark, root), dictionary, cfg)
    reader = spark.read.schema("tx_id long, value string")
    folders = [(reader.parquet(f"{source}/part={number}"), number) for number in batches]
    try:
        for batch, following in zip(folders, [*folders[1:], None]):
            engine.process_batch(*batch, following)
    finally:
        engine.discard()
    return engine.tables


def stored_run(spark: SparkSession, sf_dir: str, cfg: EngineConfig) -> Tables:
    """The tables of one run over all transactions, opened by a reader of their own.

    A session replays each data set once; queries of the stored tables share the run.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        _RUNS[key] = replay(spark, sf_dir, cfg, STORED_HOURS).root
    return Tables(spark, _RUNS[key])
