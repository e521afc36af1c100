"""Small batches take few jobs, crowded ones many tasks; both store the same rows."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cardwarden.config import EngineConfig
from cardwarden.plans import fixtures as fx
from cardwarden.plans import replay
from cardwarden.sources.tables import Tables
from cardwarden.streaming.engine import Engine

CFG = EngineConfig(history_hours=48, days_before_training=99)


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.range(400).select(
        F.col("id").alias("tx_id"), (F.col("id") % 9).cast("string").alias("cardid"), F.col("id").alias("k"),
        F.lit("view").alias("cat1_level"), F.lit("c1").alias("cat2_level"), F.lit("m1").alias("merchant_level"),
        F.lit("a,1").alias("merchantarea_level"), (F.col("id") * 0.5).alias("tx_amount"),
        (F.timestamp_seconds(F.lit(1_700_000_400) + F.col("id") * 300)).alias("tx_datetime"),
        (F.col("id") % 2 == 0).alias("boo1"), F.lit(True).alias("boo2"), F.lit(30).alias("age"),
        F.lit(1).alias("nationality"), F.lit(1).alias("gender"), F.lit(1).alias("cat3"), F.lit(1).alias("cat4"),
        (F.col("id") % 40 == 0).alias("label"), F.expr("CAST(id * 300 DIV 3600 AS INT)").alias("tx_dhour"),
    )
    return made


def stored(spark, rows, root, cfg):
    """Three batches that share hours, the jobs of the last one, and the tables."""
    lines = fx.raw_lines(rows).withColumn("part", F.expr("tx_id DIV 150"))
    engine = Engine(Tables(spark, root), fx.dictionary(rows), cfg)
    for part in range(3):
        spark.sparkContext.setJobGroup(f"{root}-{part}", "batch")
        engine.process_batch(lines.where(F.col("part") == part).select("tx_id", "value"), part)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{root}-2"))
    spark.sparkContext.setJobGroup("", "")
    return jobs, engine.tables


def test_small_batches_take_fewer_jobs_and_store_the_same(spark, rows, tmp_path):
    few, small = stored(spark, rows, str(tmp_path / "small"), CFG)
    many, large = stored(spark, rows, str(tmp_path / "large"), replace(CFG, one_task_rows=0))
    assert few <= many - 3
    assert small.history().count() == large.history().count() > 300
    assert small.history().exceptAll(large.history()).isEmpty()
    every = (99, 10**6, 2 * 10**6)
    assert small.rollup(*every).exceptAll(large.rollup(*every)).isEmpty()
    assert large.rollup(*every).exceptAll(small.rollup(*every)).isEmpty()


def test_state_row_keeps_every_value(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "root"))
    tables._log, tables._retired = {("history", 3, -2), ("rollup", 3, 5)}, {("history", 1, 0)}
    values = dict(
        epoch=2, batch_id=2**53 + 1, origin_ms=-5, clock_ms=10**15, day=4, models=["recent-4-3", 'a"b'],
        forest=None, alerts_batch=None, n_in=7, n_dropped=0, n_alerts=1,
    )
    tables.commit_state(**values)
    state = tables.last_state().asDict(recursive=True)
    assert {k: state[k] for k in values} == values
    assert [tuple(f.values()) for f in state["folders"]] == [("history", 3, -2), ("rollup", 3, 5)]
    assert [tuple(f.values()) for f in state["retired"]] == [("history", 1, 0)]


def test_crowded_batch_is_written_as_many_files(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(replay, "FILE_LINES", 50)
    lines = fx.raw_lines(rows).withColumn("part", F.lit(7))
    path = str(tmp_path / "lines")
    assert replay.write_batches(lines, "part", path) == [7]
    written = spark.read.parquet(f"{path}/part=7")
    files = written.groupBy(F.input_file_name()).count().agg(F.count("*"), F.max("count")).first()
    assert files[0] >= 8 and files[1] <= 50
    assert written.exceptAll(lines.select("tx_id", "value")).isEmpty() and written.count() == 400
