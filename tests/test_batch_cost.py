"""What a small batch saves: joins, listings, passes and waits; its rows stay the same."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cardwarden.config import EngineConfig
from cardwarden.operators import bags
from cardwarden.operators.encode import Dictionary, encode_id, encode_risk
from cardwarden.operators.history import rolled_stats
from cardwarden.plans import fixtures as fx
from cardwarden.session import give_back
from cardwarden.sources.tables import Tables
from cardwarden.streaming.engine import Engine

CFG = EngineConfig(history_hours=48, days_before_training=99)
EVERY = (99, 10**6, 2 * 10**6)


def rows_of(spark, n=1200):
    return spark.range(n).select(
        F.col("id").alias("tx_id"), (F.col("id") % 9).cast("string").alias("cardid"), F.col("id").alias("k"),
        F.lit("view").alias("cat1_level"), F.concat(F.lit("c"), F.col("id") % 5).alias("cat2_level"),
        F.lit("m1").alias("merchant_level"), F.lit("a,1").alias("merchantarea_level"),
        (F.col("id") * 0.5).alias("tx_amount"),
        (F.timestamp_seconds(F.lit(1_700_000_400) + F.col("id") * 300)).alias("tx_datetime"),
        (F.col("id") % 2 == 0).alias("boo1"), F.lit(True).alias("boo2"), F.lit(30).alias("age"),
        F.lit(1).alias("nationality"), F.lit(1).alias("gender"), F.lit(1).alias("cat3"), F.lit(1).alias("cat4"),
        (F.col("id") % 40 == 0).alias("label"), F.expr("CAST(id * 300 DIV 3600 AS INT)").alias("tx_dhour"),
    )


@pytest.fixture(scope="module")
def source(spark):
    rows = rows_of(spark)
    # Batches of half a day that share hours, and a late row of an earlier batch's hour in each.
    late = F.when(F.col("tx_id") % 75 == 1, F.col("tx_id") + 140).otherwise(F.col("tx_id"))
    lines = fx.raw_lines(rows).withColumn("part", F.call_function("div", late, F.lit(140)))
    return lines.persist(), fx.dictionary(rows)


def part(source, number):
    return source[0].where(F.col("part") == number).select("tx_id", "value")


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_few_levels_are_looked_up_without_a_join(spark):
    kinds = "variable string, level string, id int, risk double"
    found = [("cat1", "x", 0, 0.1), ("cat1", "é\"\\,", 0, 1 / 3), ("cat1", None, 0, 0.7), ("cat2", "x", 0, None),
             ("merchant", "m", 0, float("nan")), ("TERM_COUNTRY", "d", 1, 0.2), ("TERM_COUNTRY", "d", 2, 0.4),
             ("GENDER", "g", 2, 0.0), ("cat3", "t", None, 0.0), ("nationality", "n", -1, 0.0)]
    found += [("cat4", f"u{i}", i, 0.0) for i in range(200)]
    entries = spark.createDataFrame(found, kinds)
    levels = ["x", 'é"\\,', None, "m", "d", "g", "t", "n", "u7", "u199", ""]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(levels)], "tx_id long, v string").select(
        "tx_id", *[F.col("v").alias(f"{c}_level") for c in
                   ("cat1", "cat2", "merchant", "merchantarea", "nationality", "gender", "cat3", "cat4")])
    quick, joins = Dictionary.of(entries, CFG), Dictionary(entries)
    # A risk that JSON can't tell and a level that comes twice keep their joins.
    assert set(quick.literals) == {"cat1", "cat2", "GENDER", "cat3", "nationality", "cat4"} and not joins.literals
    assert set(Dictionary.of(entries, replace(CFG, broadcast_rows=5)).literals) == set(quick.literals) - {"cat4"}
    for encode in (encode_risk, encode_id):
        a, b = encode(rows, quick, CFG), encode(rows, joins, CFG)
        assert a.columns == b.columns
        got, want = (sorted(map(repr, x.collect())) for x in (a, b))
        assert got == want
    assert "Join" not in encode_id(rows, quick, CFG)._jdf.queryExecution().executedPlan().toString()


def test_window_holds_what_the_folders_hold(spark, source, tmp_path):
    """Statistics of late and shared hours, read from the one file and from all folders; restarts have no file."""
    root = str(tmp_path / "root")
    engine = Engine(Tables(spark, root), source[1], CFG)
    used = 0
    for number in range(9):
        if number == 6:
            engine = Engine(Tables(spark, root), source[1], CFG)
        if number:
            state = engine.tables.begin(number)
            hour = (state["clock_ms"] - state["origin_ms"]) // 3_600_000 + 12
            mine = engine.tables.rollup(number, hour, CFG.history_hours)
            used += "/_window/" in mine.inputFiles()[0] and len(mine.inputFiles()) == 1
            folders = Tables(spark, root).rollup(number, hour, CFG.history_hours)
            assert len(folders.inputFiles()) > 9 and same(rolled_stats(mine), rolled_stats(folders))
        engine.process_batch(part(source, number), number)
    assert used == 7
    # A rerun starts from the folders, as the file knows more than it may see.
    engine.tables.begin(8)
    assert not any("/_window/" in f for f in engine.tables.rollup(8, 80, 48).inputFiles())


def test_stored_batches_take_no_job_to_be_opened(spark, source, tmp_path):
    engine = Engine(Tables(spark, str(tmp_path / "root")), source[1], CFG)
    for number in range(4):
        engine.process_batch(part(source, number), number)
    assert len(engine.tables._folders("history")) > 36
    spark.sparkContext.setJobGroup(f"{tmp_path}-open", "open")
    stored = engine.tables.history()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"{tmp_path}-open")
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) == 0 and stored.count() > 400
    # Of a batch that is named in part, only the named hours are read.
    some = engine.tables._folders("history")[1:]
    assert len(engine.tables._open(stored.schema, some).inputFiles()) == len(stored.inputFiles()) - 1


def test_following_batch_is_parsed_ahead_and_stored_the_same(spark, source, tmp_path):
    one, two = (Engine(Tables(spark, str(tmp_path / n)), source[1], CFG) for n in ("one", "two"))
    batches = [(part(source, n), n) for n in range(4)]
    for batch, following in zip(batches, [*batches[1:], None]):
        one.process_batch(*batch)
        two.process_batch(*batch, following)
        assert (two._ahead is None) == (following is None)
    assert same(one.tables.history(), two.tables.history())
    assert same(one.tables.rollup(*EVERY), two.tables.rollup(*EVERY))
    assert same(one.tables.rejects(), two.tables.rejects()) and two.tables.rejects().count() > 0
    # What was parsed ahead is seen by no reader before its batch, nor used by another one.
    late = part(source, 5)
    two.process_batch(part(source, 4), 4, (late, 5))
    assert two._ahead[2].result()[1][0] > 0
    assert two.tables.rejects().where("batch_id = 5").isEmpty()
    two.process_batch(part(source, 6), 5)
    assert two._ahead is None
    assert same(two.tables.rejects().where("batch_id = 5").select("tx_id", "value"),
                part(source, 6).where("tx_id % 97 = 0 OR tx_id % 89 = 0"))


def test_bags_of_few_rows_are_the_bags_of_many(spark, source, tmp_path, monkeypatch):
    engine = Engine(Tables(spark, str(tmp_path / "root")), source[1], CFG)
    for number in range(3):
        engine.process_batch(part(source, number), number)
    stored = engine.tables.history()
    few = bags.bags_of_history(stored, CFG)
    monkeypatch.setattr(bags, "few_bytes", lambda _: False)
    many = bags.bags_of_history(stored, CFG).select(few.columns)
    assert few.count() > 0 and same(few, many)


def test_a_small_batch_takes_few_jobs(spark, source, tmp_path):
    engine = Engine(Tables(spark, str(tmp_path / "root")), source[1], CFG)
    jobs = []
    for number in range(6):
        spark.sparkContext.setJobGroup(f"{tmp_path}-{number}", "batch")
        engine.process_batch(part(source, number), number)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{tmp_path}-{number}")))
    spark.sparkContext.setJobGroup("", "")
    assert max(jobs[2:]) <= 11


def test_memory_is_given_back(spark):
    give_back(spark)
    assert spark.range(3).count() == 3
