"""The commit log of stored folders, the epochs of engines, and the source's rate and start."""

import pytest
from pyspark.sql import functions as F

from cardwarden.config import EngineConfig
from cardwarden.operators.parse import parse_lines
from cardwarden.plans import fixtures as fx
from cardwarden.session import materialize
from cardwarden.sources.readers import read_transactions, source_options
from cardwarden.sources.tables import Fenced, Tables
from cardwarden.streaming.engine import Engine, run_stream

CFG = EngineConfig(history_hours=48, days_before_training=99, spare_folders=0)


@pytest.fixture(scope="module")
def source(spark, sf_dir):
    rows = fx.tx(spark, sf_dir)
    lines = fx.raw_lines(rows).withColumn("half", F.expr("tx_dhour DIV 12")).where("half < 12")
    return materialize(lines.select("tx_id", "value", "half"), "log-lines"), fx.dictionary(rows)


def batch(source, half):
    return source[0].where(F.col("half") == half).select("tx_id", "value")


def test_what_was_not_committed_is_not_seen(spark, source, tmp_path, monkeypatch):
    root = str(tmp_path / "root")
    engine = Engine(Tables(spark, root), source[1], CFG)
    engine.process_batch(batch(source, 0), 0)
    before = materialize(Tables(spark, root).history(), "before")
    rejected = Tables(spark, root).rejects().count()

    def crash(**_):
        raise OSError("lost before the commit")

    monkeypatch.setattr(engine.tables, "commit_state", crash)
    with pytest.raises(OSError):
        engine.process_batch(batch(source, 1), 1)
    # The files are there, and neither an open nor a new reader sees them.
    assert Tables(spark, root)._values(f"{root}/history", "batch_id") == [0, 1]
    reader = Tables(spark, root)
    assert reader.history().count() == before.count() and before.exceptAll(reader.history()).isEmpty()
    assert reader.rejects().count() == rejected
    assert reader.rollup(99, 10**6, 2 * 10**6).where("batch_id = 1").isEmpty()

    # A rerun by a new engine, of other rows, leaves nothing of the first try.
    again = Engine(Tables(spark, root), source[1], CFG)
    again.process_batch(batch(source, 2), 1)
    wanted = source[0].where("half = 2")
    stored = reader.history().where("batch_id = 1")
    assert stored.count() > 0 and stored.join(wanted, "tx_id", "left_anti").isEmpty()


def test_log_names_every_folder_and_deletes_one_commit_later(spark, source, tmp_path):
    root = str(tmp_path / "root")
    engine = Engine(Tables(spark, root), source[1], CFG)
    tables = engine.tables
    dropped = set()
    for number in range(10):
        last = tables.last_state(number)
        engine.process_batch(batch(source, number), number)
        state = tables.last_state()
        log = {tuple(f) for f in state["folders"]}
        clock = (state["clock_ms"] - state["origin_ms"]) // 3_600_000
        assert all(hour > clock - CFG.history_hours for _, _, hour in log)
        assert {t for t, _, _ in log} == {"history", "rollup"}
        # All that this state or the one before it names can be read: a rerun finds its folders.
        names = log | ({tuple(f) for f in last["folders"]} if last else set())
        assert all(tables._fs.exists(tables._path(tables._stored_in(f))) for f in names)
        gone = {tuple(f) for f in last["retired"]} if last else set()
        assert not any(tables._fs.exists(tables._path(tables._stored_in(f))) for f in gone)
        dropped |= gone
    assert dropped
    before = materialize(Tables(spark, root).history(), "before")
    Engine(Tables(spark, root), source[1], CFG).process_batch(batch(source, 9), 9)
    after = Tables(spark, root).history()
    assert after.count() == before.count() and before.exceptAll(after).isEmpty()


def test_reads_open_logged_folders_only(spark, source, tmp_path):
    tables = Tables(spark, str(tmp_path / "root"))
    engine = Engine(tables, source[1], CFG)
    for number in range(3):
        engine.process_batch(batch(source, number), number)
    files = tables.history(2).inputFiles()
    assert files and not [f for f in files if "batch_id=2" in f]
    assert all("batch_id=1/" in f for f in tables.stored_batch(1).inputFiles())
    assert Tables(spark, str(tmp_path / "none")).history().isEmpty()


def test_second_engine_stops_the_first(spark, source, tmp_path):
    root = str(tmp_path / "root")
    first = Engine(Tables(spark, root), source[1], CFG)
    first.process_batch(batch(source, 0), 0)
    second = Engine(Tables(spark, root), source[1], CFG)
    with pytest.raises(Fenced):
        first.process_batch(batch(source, 1), 1)
    assert Tables(spark, root).batch_metrics().count() == 1
    second.process_batch(batch(source, 1), 1)
    assert [s["epoch"] for s in (second.tables.last_state(1), second.tables.last_state())] == [1, 2]
    assert second.tables.folders("epochs") == ["2"]


def test_counts_come_from_the_passes_that_write(spark, source, tmp_path):
    root, lines = str(tmp_path / "root"), "tx_id long, value string"
    engine = Engine(Tables(spark, root), source[1], CFG)
    none = spark.createDataFrame([], lines)
    engine.process_batch(none, 0)
    engine.process_batch(batch(source, 1).limit(0), 1)
    assert engine.tables.last_state() is None
    bad = spark.createDataFrame([(1, "no fields"), (2, ""), (3, None)], lines)
    engine.process_batch(batch(source, 0), 2)
    engine.process_batch(bad, 3)
    engine.process_batch(batch(source, 1).unionByName(bad), 4)
    engine.process_batch(none, 5)
    found = {r["batch_id"]: (r["n_in"], r["n_dropped"]) for r in engine.tables.batch_metrics().collect()}
    want = {}
    for number, rows in ((2, batch(source, 0)), (3, bad), (4, batch(source, 1).unionByName(bad))):
        reasons = [r["reject_reason"] for r in parse_lines(rows, CFG).collect()]
        want[number] = (len(reasons), sum(r is not None for r in reasons))
    assert found == want and want[3] == (3, 3) and want[2][0] > want[2][1] > 0
    stored = Tables(spark, root).rejects().groupBy("batch_id").count().collect()
    assert {r["batch_id"]: r["count"] for r in stored} == {n: dropped for n, (_, dropped) in want.items()}
    # A replaced engine has nothing to write for an empty batch, and lets it pass.
    Engine(Tables(spark, root), source[1], CFG)
    engine.process_batch(none, 6)
    with pytest.raises(Fenced):
        engine.process_batch(bad, 7)


def test_an_engine_replaced_in_mid_batch_does_not_commit(spark, source, tmp_path):
    root = str(tmp_path / "root")
    first = Engine(Tables(spark, root), source[1], CFG)
    append = first.tables.append_rollup

    def replaced(number):
        append(number)
        Tables(spark, root).claim()

    first.tables.append_rollup = replaced
    with pytest.raises(Fenced):
        first.process_batch(batch(source, 0), 0)
    assert Tables(spark, root).last_state() is None and Tables(spark, root).history().isEmpty()


def test_source_options():
    cfg = EngineConfig(max_per_trigger=500, start_ms=1_700_000_000_000)
    assert source_options("kafka", cfg) == {
        "startingOffsets": "earliest", "startingTimestamp": "1700000000000",
        "startingOffsetsByTimestampStrategy": "latest", "maxOffsetsPerTrigger": "500",
    }
    assert source_options("text", cfg) == {"maxFilesPerTrigger": "500"}
    assert source_options("text", EngineConfig()) == {}
    with pytest.raises(ValueError):
        EngineConfig(max_per_trigger=0)


def test_rate_and_start_of_a_folder(spark, source, tmp_path):
    """Three files of one row; the first is older than the start, the others come one a batch."""
    folder, root = tmp_path / "in", str(tmp_path / "root")
    rows = [r["value"] for r in batch(source, 0).limit(3).collect()]
    folder.mkdir()
    import os

    for at, value in enumerate(rows):
        (folder / f"{at}.txt").write_text(value + "\n")
        os.utime(folder / f"{at}.txt", (1_700_000_000 + at, 1_700_000_000 + at))
    cfg = EngineConfig(max_per_trigger=1, start_ms=1_700_000_001_000)
    engine = Engine(Tables(spark, root), source[1], cfg)
    lines = read_transactions(spark, "text", {}, str(folder), cfg)
    run_stream(lines, engine, f"{root}/checkpoint", available_now=True).awaitTermination()
    assert [m.n_in for m in engine.tables.batch_metrics().orderBy("batch_id").collect()] == [1, 1]
