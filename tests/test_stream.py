"""The engine: replay against batch, reruns, restart, late rows, retention, alerts, tables."""

import os

import pytest
from oracle_check import connect, difference
from pyspark.sql import functions as F

from cardwarden.config import EngineConfig
from cardwarden.functions.clock import with_time_fields
from cardwarden.operators.asof import asof_batches, batch_clocks
from cardwarden.operators.encode import encode_id, encode_risk
from cardwarden.operators.history import latest_per_key
from cardwarden.operators.parse import accepted, parse_lines
from cardwarden.plans import fixtures as fx
from cardwarden.plans.oracle import ORACLE
from cardwarden.plans.queries import REGISTRY
from cardwarden.schema import AMOUNT_STATS, AREA_STATS, LAST_TX
from cardwarden.session import materialize, scratch_scope
from cardwarden.sources.readers import read_dictionary, read_transactions
from cardwarden.sources.tables import Tables, current_tables, new_tables
from cardwarden.streaming.engine import Engine, run_stream

CFG = EngineConfig(n_tree=2, feedback_trees=5, tree_depth=5, fit_parallelism=4)
DAYS = 10


@pytest.fixture(scope="module")
def source(spark, sf_dir):
    rows = fx.tx(spark, sf_dir)
    lines = fx.raw_lines(rows).withColumn("day", F.expr("tx_dhour DIV 24")).where(f"day < {DAYS}")
    return materialize(lines.select("tx_id", "value", "day"), "test-lines"), fx.dictionary(rows)


def write_text_batches(lines, batch, path):
    """Write lines as text, one folder per batch, in time order for a file stream.

    A file stream takes files by their modification time, so each batch's files get a time of
    their own. The files of one batch share it; ``maxFilesPerTrigger`` is their common number.
    """
    spark = lines.sparkSession
    one = lines.select("value", F.col(batch).alias("part")).repartition("part")
    one.write.partitionBy("part").text(path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [s.getPath() for s in fs.listStatus(hadoop.Path(path))]
    parts = {int(f.getName().split("=")[1]): f for f in folders if "=" in f.getName()}
    start = 1_700_000_000_000
    for at, number in enumerate(sorted(parts)):
        for status in fs.listStatus(parts[number]):
            fs.setTimes(status.getPath(), start + at * 1000, -1)
    return len(parts)


def day_lines(lines, day):
    return lines.where(F.col("day") == day).select("tx_id", "value")


@pytest.fixture(scope="module")
def run(spark, source, tmp_path_factory):
    """The first days, a day per batch; expired hours stay on disk so all rows can be compared."""
    lines, dictionary = source
    engine = Engine(Tables(spark, str(tmp_path_factory.mktemp("run"))), dictionary, CFG)
    engine.tables.expire_history = lambda *_: []
    for day in range(DAYS):
        engine.process_batch(day_lines(lines, day), day)
    return engine


def test_stored_features_equal_the_batch_replay(spark, source, run):
    lines, dictionary = source
    good = accepted(parse_lines(lines, CFG))
    origin = good.where("day = 0").agg(F.min(F.unix_millis("tx_datetime"))).first()[0]
    rows = with_time_fields(good, origin)
    rows = encode_id(encode_risk(rows, dictionary, CFG), dictionary, CFG)
    rows = rows.withColumn("batch_seq", F.col("day").cast("bigint"))
    want = asof_batches(rows, batch_clocks(rows, origin), CFG)
    cols = ["tx_id", "tx_dhour", "cat1", "merchant", "nationality", *AMOUNT_STATS, *AREA_STATS, *LAST_TX]
    got = run.tables.history().select(cols)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want.select(cols)).isEmpty()


def test_scores_start_with_the_first_model(run):
    rows = run.tables.history()
    assert rows.where("batch_id < 4 AND zfraud_pr <> 0.1").isEmpty()
    later = rows.where("batch_id >= 4")
    assert later.where("NOT (zfraud_pr BETWEEN 0 AND 1)").isEmpty()
    assert later.where("batch_id < 8 AND zfraud_pr_f <> -1").isEmpty()
    assert later.where("batch_id >= 8 AND zfraud_pr_f < 0").isEmpty()


def test_daily_alerts_are_the_top_of_the_day(run):
    alerts = run.tables.alerts()
    stored = run.tables.history()
    days = {r.day for r in alerts.select("day").distinct().collect()}
    clock_days = {r.batch_id: r.day for r in run.tables.batch_metrics().collect()}
    assert days and min(days) >= 4
    for day in days:
        batches = [b for b, d in clock_days.items() if d == day]
        rows = stored.where(F.col("batch_id").isin(batches)).orderBy(F.desc("zfraud_pr"), "tx_id")
        want = [(i + 1, r.tx_id, r.label) for i, r in enumerate(rows.limit(20).collect())]
        got = alerts.where(F.col("day") == day).orderBy("tx_rank").collect()
        assert [(r.tx_rank, r.tx_id, r.label) for r in got] == want


def test_metrics_and_rejects(source, run):
    lines, _ = source
    metrics = {r.batch_id: r for r in run.tables.batch_metrics().collect()}
    assert sorted(metrics) == list(range(DAYS))
    assert sum(m.n_in for m in metrics.values()) == lines.count()
    assert sum(m.n_dropped for m in metrics.values()) == run.tables.rejects().count()
    reasons = {r.reject_reason for r in run.tables.rejects().collect()}
    assert reasons == {"arity", "datetime"}


def test_models_follow_the_schedule(run):
    state = run.tables.last_state(DAYS)
    (model,) = state["models"]
    assert model.startswith("delayed-") and state["forest"].startswith("feedback-")


def test_rerun_of_a_batch_changes_nothing(spark, source, run):
    lines, dictionary = source
    before = materialize(run.tables.history(), "before")
    alerts = materialize(run.tables.alerts(), "before-alerts")
    metrics = run.tables.batch_metrics().collect()
    again = Engine(run.tables, dictionary, CFG)  # models come from the saved registry
    again.process_batch(day_lines(lines, DAYS - 1), DAYS - 1)
    after = run.tables.history()
    assert before.exceptAll(after).isEmpty() and after.count() == before.count()
    assert alerts.exceptAll(run.tables.alerts()).isEmpty()
    assert sorted(run.tables.batch_metrics().collect()) == sorted(metrics)


def test_empty_batch_is_skipped(spark, source, run):
    before = run.tables.batch_metrics().count()
    run.process_batch(spark.createDataFrame([], "tx_id long, value string"), 900)
    assert run.tables.batch_metrics().count() == before


def test_history_reads_choose_folders(run):
    rows = run.tables.history(7, 150, 120).select("cardid", "tx_amount")
    text = rows._jdf.queryExecution().executedPlan().toString()
    head = text[text.index("PartitionFilters") :].split("PushedFilters")[0]
    assert "tx_dhour" in head and "batch_id" in head
    assert "struct<cardid:string,tx_amount:double>" in text


def test_compaction_keeps_the_last_write_of_every_key(spark, run, tmp_path):
    rows = materialize(run.tables.history().where("batch_id < 2"), "two-days")
    tables = Tables(spark, str(tmp_path))
    tables.append_history(rows.where("batch_id = 0"), 0)
    again = rows.where("batch_id = 0 AND tx_id % 2 = 0")
    tables.append_history(again.withColumn("tx_amount", F.col("tx_amount") + 1), 1)
    tables.append_history(rows.where("batch_id = 1"), 2)
    want = materialize(latest_per_key(tables.history(), ["batch_id", "tx_id"]).drop("batch_id"), "want")
    crowded = {r.tx_dhour for r in again.select("tx_dhour").distinct().collect()}
    assert tables.compact_history(10_000, 3, spare=len(crowded)) == []
    assert set(tables.compact_history(10_000, 3)) == crowded
    got = tables.history().drop("batch_id").select(want.columns)
    assert got.count() == want.count() and want.exceptAll(got).isEmpty()
    assert tables.compact_history(10_000, 3) == []


def test_stream_restart_late_rows_and_retention(spark, source, tmp_path):
    """A file stream, stopped after two batches and restarted by a new engine, plus a late file."""
    lines, dictionary = source
    cfg = EngineConfig(history_hours=24, days_before_training=99)
    wanted = lines.where("day IN (0, 1, 3)")
    first, second = str(tmp_path / "in"), str(tmp_path / "root")
    late = wanted.where("day = 0").limit(7).withColumn("day", F.lit(9)).withColumn(
        "value", F.concat(F.lit("late"), "value")  # new cards, old times
    )
    assert write_text_batches(wanted.select("value", "day").unionByName(late.select("value", "day")), "day", first) == 4

    def go(options):
        engine = Engine(Tables(spark, second), dictionary, cfg)
        stream = read_transactions(spark, "text", options, first)
        query = run_stream(stream, engine, second + "/checkpoint", available_now=True)
        return engine, query

    engine, query = go({"maxFilesPerTrigger": "1"})
    query.awaitTermination()
    metrics = engine.tables.batch_metrics().orderBy("batch_id").collect()
    assert [m.day for m in metrics] == [0, 0, 2, 2] or [m.day for m in metrics] == [0, 1, 3, 3]
    # The late rows were scored in the last batch, then expired with their hours.
    assert metrics[-1].n_in == 7
    state = engine.tables.last_state(99)
    clock_hour = (state["clock_ms"] - state["origin_ms"]) // 3_600_000
    assert engine.tables.history().where(F.col("tx_dhour") <= clock_hour - 24).isEmpty()
    # Restart: nothing new, state as it was; then a new file goes on with the next batch id.
    engine, query = go({"maxFilesPerTrigger": "1"})
    query.awaitTermination()
    assert engine.tables.batch_metrics().count() == 4
    more = spark.createDataFrame([(lines.where("day = 4").first()["value"],)], "value string")
    more.coalesce(1).write.mode("append").text(first + "/part=10")
    engine, query = go({"maxFilesPerTrigger": "1"})
    query.awaitTermination()
    assert [m.batch_id for m in engine.tables.batch_metrics().orderBy("batch_id").collect()] == [0, 1, 2, 3, 4]
    assert engine.tables.last_state(99)["origin_ms"] == state["origin_ms"]


def test_dictionary_file_first_line_wins(spark, tmp_path):
    path = tmp_path / "dictionary.csv"
    path.write_text('cat1,0,click,0.25\nTERM_COUNTRY,0,"a,8",0.5\ncat1,0,click,0.75\nGENDER,2,g1,x\n')
    entries = {(r.variable, r.level): (r.id, r.risk) for r in read_dictionary(spark, str(path), CFG).entries.collect()}
    assert entries == {("cat1", "click"): (0, 0.25), ("TERM_COUNTRY", "a,8"): (0, 0.5), ("GENDER", "g1"): (2, None)}


def test_reset_starts_with_new_tables(spark, tmp_path):
    root = str(tmp_path / "tables")
    a, b = new_tables(spark, root, reset=True), new_tables(spark, root, reset=True)
    assert a.root != b.root and b.history().isEmpty() and b.last_state(1) is None
    assert new_tables(spark, root).root == root


def test_alert_list_outlives_batches_without_good_rows(spark, tmp_path):
    """Twelve all-reject batches write no list; the one that the state names must stay."""
    tables = Tables(spark, str(tmp_path / "tables"))
    for batch in (1, 2):
        path = tables.path("alerts_current", f"batch_id={batch}")
        spark.range(1).write.parquet(path)
    for batch in range(3, 16):
        tables.prune(batch)
    assert tables._values(tables.path("alerts_current"), "batch_id") == [1, 2]
    for batch in range(3, 40):
        spark.range(1).write.parquet(tables.path("alerts_current", f"batch_id={batch}"))
        tables.prune(batch)
    assert len(tables._values(tables.path("alerts_current"), "batch_id")) == 11


def test_reset_is_remembered_by_later_starts(spark, tmp_path):
    root = str(tmp_path / "root")
    assert current_tables(spark, root).root == root
    assert current_tables(spark, root, reset=True).root == f"{root}-0"
    assert current_tables(spark, root).root == f"{root}-0"
    assert current_tables(spark, root, reset=True).root == f"{root}-1"
    assert current_tables(spark, root).root == f"{root}-1"


def test_replay_matches_its_sql(spark, sf_dir, tmp_path):
    """Nine days of half-day batches cross every branch of the schedule."""
    for name in os.listdir(sf_dir):
        os.symlink(f"{sf_dir}/{name}", tmp_path / name) if name != "events.parquet" else None
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    start = events.agg(F.min("ts")).scalar()
    events.where(F.col("ts") < start + F.expr("INTERVAL 9 DAYS")).write.parquet(str(tmp_path / "events.parquet"))
    con = connect(sf_dir)
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    result = REGISTRY["stream_replay"](spark, str(tmp_path))
    assert difference(result, con, ORACLE["stream_replay"]) is None
    assert result.where("n_alerts > 0").count() > 0


def test_state_and_models_stay_few(spark, tmp_path):
    """Folded days keep their metrics; a rerun's state and models stay."""
    tables = Tables(spark, str(tmp_path / "tables"))
    models = Engine(tables, read_dictionary_of_nothing(spark, tmp_path)).models
    for batch in range(24):
        day = batch // 2
        spark.range(1).write.mode("overwrite").parquet(tables.path("models", f"recent-{day}-{batch}"))
        tables.commit_state(
            batch_id=batch, origin_ms=0, clock_ms=0, day=day, models=[f"recent-{day}-{batch}"],
            forest=None, alerts_batch=None, n_in=batch, n_dropped=0, n_alerts=0,
        )
        if batch and batch % 2 == 0:
            models.drop({f"recent-{day}-{batch}", f"recent-{day - 1}-{batch - 1}", None})
            tables.fold_state(day - 1)
            assert len(tables._values(tables.path("state"), "day")) == 2
            assert len(tables.folders("models")) == 2
        before = tables.last_state(batch)
        assert (before["batch_id"] if before else None) == (batch - 1 if batch else None)
    assert [r.n_in for r in tables.batch_metrics().orderBy("batch_id").collect()] == list(range(24))


def read_dictionary_of_nothing(spark, folder):
    path = folder / "dictionary.csv"
    path.write_text("cat1,0,click,0.25\n")
    return read_dictionary(spark, str(path), CFG)


def test_scratch_scope_drops_its_own_tables_only(spark):
    def folder(df):
        return os.path.dirname(df.inputFiles()[0].removeprefix("file:"))

    outside = folder(materialize(spark.range(3), "outside"))
    with scratch_scope(spark):
        inside = folder(materialize(spark.range(3), "inside"))
        assert os.path.isdir(inside)
    assert not os.path.exists(inside) and os.path.isdir(outside)


def test_rollup_states_every_stored_hour_and_serves_the_features(run):
    """The last version of each (card, hour) equals the statistics of its stored rows, and features
    read the rollup alone."""
    from cardwarden.operators.history import batch_cards, partial_stats

    tables = run.tables
    want = latest_per_key(tables.history(), ["batch_id", "tx_id"]).groupBy("cardid", "tx_dhour").agg(*partial_stats())
    parts = [c for c in want.columns if c.startswith("p_")]
    rolled = tables.rollup(10**9, 10**6, 2 * 10**6).groupBy("cardid", "tx_dhour")
    got = rolled.agg(*[F.max_by(c, "batch_id").alias(c) for c in parts]).select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    rows = tables.stored_batch(DAYS - 1).select("tx_id", "cardid")
    now = run._advance(tables.last_state(DAYS), None)
    joined = run._with_features(rows, batch_cards(rows), now, DAYS, 1)
    files = joined.inputFiles()
    assert any("/rollup/" in f for f in files)
    assert not [f for f in files if "/history/" in f and f"batch_id={DAYS - 1}" not in f]
