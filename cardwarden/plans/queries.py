"""Registered queries: every operator of the engine over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardwarden.functions.clock import with_time_fields
from cardwarden.functions.scores import ensemble, mean_of
from cardwarden.operators import alerts as al
from cardwarden.operators.asof import asof_batches, asof_hourly, batch_clocks, card_stats
from cardwarden.operators.bags import balanced_bags, training_days
from cardwarden.operators.encode import encode_id, encode_risk
from cardwarden.operators.history import (
    HISTORY_COLUMNS,
    batch_cards,
    latest_per_key,
    of_batch_cards,
    stored_counts,
)
from cardwarden.operators.joins import fits_broadcast, hot_keys, spread_join
from cardwarden.operators.models import (
    score_delayed,
    score_feedback,
    train_delayed,
    train_feedback,
    unscored,
)
from cardwarden.operators.parse import accepted, parse_lines, rejects
from cardwarden.operators.vectors import vector_columns, with_vector
from cardwarden.plans import fixtures as fx
from cardwarden.plans.replay import replay, stored_run
from cardwarden.plans.schedule import schedule
from cardwarden.schema import AMOUNT_STATS, AREA_STATS, LAST_TX, TX_FEATURES, typed
from cardwarden.session import materialize
from cardwarden.sources.readers import parse_dictionary

CFG = fx.CFG
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return add


def _ms(df: DataFrame) -> DataFrame:
    """Show the transaction time as epoch milliseconds."""
    return df.withColumn("tx_datetime", F.unix_millis("tx_datetime"))


def _last_day(rows: DataFrame):
    """The last day of the stream, as a scalar subquery."""
    return rows.agg(F.max(F.call_function("div", F.col("tx_dhour"), F.lit(24)).cast("int"))).scalar()


# --- parsing and encoding ------------------------------------------------------------------


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(fx.raw_lines(fx.tx(spark, sf_dir)), CFG)

@query("parse_tx")
def parse_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ms(accepted(_parsed(spark, sf_dir)).drop("tx_dhour"))

@query("parse_rejects")
def parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects(_parsed(spark, sf_dir)).select("tx_id", "reject_reason")

@query("time_fields")
def time_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.tx(spark, sf_dir)
    origin = rows.agg(F.min(F.unix_millis("tx_datetime"))).scalar()
    good = accepted(parse_lines(fx.raw_lines(rows), CFG))
    return with_time_fields(good, origin).select("tx_id", "tx_dhour", "tx_hour", "tx_dayw")

@query("dict_load")
def dict_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary lines read back to entries; a later line of a known level is not used."""
    entries = fx.dictionary_entries(fx.tx(spark, sf_dir))
    line = F.concat(
        F.col("variable"), F.lit(","), F.col("id").cast("string"), F.lit(',"'), F.col("level"),
        F.lit('",'),
    )
    first = entries.select(
        F.concat(line, F.col("risk").cast("decimal(9,6)").cast("string")).alias("value"),
        F.lit(1).alias("line_no"),
    )
    later = entries.select(F.concat(line, F.lit("0.5")).alias("value"), F.lit(2).alias("line_no"))
    return parse_dictionary(first.unionByName(later))

@query("encode_risk")
def encode_risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.tx(spark, sf_dir)
    good = accepted(parse_lines(fx.raw_lines(rows), CFG))
    return encode_risk(good, fx.dictionary(rows), CFG).select(
        "tx_id", "cat1", "cat2", "merchant", "merchantarea"
    )

@query("encode_id")
def encode_id_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.tx(spark, sf_dir)
    good = accepted(parse_lines(fx.raw_lines(rows), CFG))
    return encode_id(good, fx.dictionary(rows), CFG).select(
        "tx_id", "nationality", "gender", "cat3", "cat4"
    )


# --- history -------------------------------------------------------------------------------


@query("history_scan")
def history_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ms(fx.encoded(spark, sf_dir).select("tx_id", *HISTORY_COLUMNS))

@query("dedupe_key")
def dedupe_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last write per key, with every tenth transaction delivered again by a later batch."""
    rows = fx.tx(spark, sf_dir).select("tx_id", "cardid", "tx_dhour", "tx_datetime", "tx_amount")
    first = rows.withColumn("batch_id", F.col("tx_dhour").cast("bigint"))
    again = (
        first.where("tx_id % 10 = 0")
        .withColumn("batch_id", F.col("batch_id") + 1)
        .withColumn("tx_amount", F.col("tx_amount") + 1)
    )
    return _ms(latest_per_key(first.unionByName(again), ["batch_id", "tx_id"]))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions replayed in one-day batches."""
    day = F.call_function("div", F.col("tx_dhour"), F.lit(24))
    return fx.encoded(spark, sf_dir).withColumn("batch_seq", day)


def _daily_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _daily(spark, sf_dir)
    return card_stats(rows, batch_clocks(rows, fx.origin_ms(rows)), CFG)


def _replayed(rows: DataFrame) -> DataFrame:
    return asof_batches(rows, batch_clocks(rows, fx.origin_ms(rows)), CFG)

@query("batch_cards")
def batch_cards_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.call_function("div", F.col("tx_dhour"), F.lit(24))
    rows = fx.tx(spark, sf_dir).withColumn("batch_seq", day)
    return batch_cards(rows, by=("batch_seq",))

@query("history_semi")
def history_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every one-day batch: the retained earlier rows of the cards in that batch.

    The days that see a row follow from its hour, so the pairs are equi-joined on (day, card).
    """
    day = F.call_function("div", F.col("tx_dhour"), F.lit(24))
    rows = fx.tx(spark, sf_dir).select("tx_id", "cardid", "tx_dhour", day.alias("own"))
    last = (F.col("tx_dhour") + CFG.history_hours - 1) / F.lit(24)
    seen = rows.withColumn(
        "batch_seq", F.explode(F.filter(
            F.sequence(F.col("own"), F.floor(last)), lambda d: d > F.col("own")
        ))
    ).drop("own")
    by_day = rows.withColumnRenamed("own", "batch_seq")
    cards = materialize(batch_cards(by_day, by=("batch_seq",)), "cards")
    few = fits_broadcast(cards, CFG.broadcast_rows)
    keys = ["batch_seq", "cardid"]
    hot = None
    if not few:
        held = materialize(stored_counts(seen, cards, by=("batch_seq",)), "stored-cards")
        hot = hot_keys(held, keys, "stored_rows", CFG.hot_rows, CFG.broadcast_rows)
    return of_batch_cards(seen, cards, few, hot, by=("batch_seq",))

@query("amount_stats")
def amount_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily_stats(spark, sf_dir).select("batch_seq", "cardid", *AMOUNT_STATS)

@query("area_stats")
def area_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily_stats(spark, sf_dir).select("batch_seq", "cardid", *AREA_STATS)

@query("last_tx")
def last_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily_stats(spark, sf_dir).select("batch_seq", "cardid", *LAST_TX)

@query("asof_features")
def asof_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a one-hour-batch replay: the flagship query."""
    return asof_hourly(fx.encoded(spark, sf_dir), CFG).select(
        "tx_id", *AMOUNT_STATS, *AREA_STATS, *LAST_TX
    )

@query("asof_features_6h")
def asof_features_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a six-hour-batch replay: eviction in hours, visibility in batches."""
    six = F.call_function("div", F.col("tx_dhour"), F.lit(6))
    rows = fx.encoded(spark, sf_dir).withColumn("batch_seq", six)
    return _replayed(rows).select("tx_id", *AMOUNT_STATS, *AREA_STATS, *LAST_TX)

@query("card_features")
def card_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed feature rows of the one-hour-batch replay."""
    rows = asof_hourly(fx.encoded(spark, sf_dir), CFG)
    return _ms(typed(rows, TX_FEATURES, extra=("tx_id",)))


# --- clocks, retention, late rows ----------------------------------------------------------


@query("batch_clock")
def batch_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.tx(spark, sf_dir).withColumn("batch_seq", F.col("tx_dhour"))
    return batch_clocks(rows, fx.origin_ms(rows))

@query("retention")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per batch hour of the stream: the hours it removes and the rows stored in them."""
    per_hour = fx.tx(spark, sf_dir).groupBy("tx_dhour").agg(F.count("*").alias("n_rows"))
    return per_hour.where(
        F.col("tx_dhour") + CFG.history_hours <= per_hour.agg(F.max("tx_dhour")).scalar()
    ).select(
        (F.col("tx_dhour") + CFG.history_hours).cast("int").alias("clock_hour"),
        F.col("tx_dhour").alias("removed_hour"),
        "n_rows",
    )

@query("retained_rows")
def retained_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the history still shows once the whole stream was stored."""
    rows = fx.tx(spark, sf_dir)
    end = rows.agg(F.max("tx_dhour")).scalar()
    return rows.where(F.col("tx_dhour") > end - CFG.history_hours).select("tx_id", "tx_dhour")


def _late(rows: DataFrame) -> DataFrame:
    """Arrival batches by hour, with some rows one to six days late."""
    late = (
        F.when(F.col("tx_id") % 50 == 0, 150).when(F.col("tx_id") % 20 == 0, 30).otherwise(0)
    )
    return rows.withColumn("batch_seq", (F.col("tx_dhour") + late).cast("bigint"))

@query("late_rows")
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late and expired rows against the clock of the batch they arrive in."""
    rows = _late(fx.tx(spark, sf_dir))
    clocks = materialize(batch_clocks(rows, fx.origin_ms(rows)), "clocks")
    hot = hot_keys(clocks, ["batch_seq"], "n_rows", CFG.hot_rows, CFG.broadcast_rows)
    hours = clocks.select("batch_seq", "clock_hour")
    return spread_join(rows, hours, ["batch_seq"], "tx_id", hot, "inner").select(
        "tx_id",
        "batch_seq",
        "tx_dhour",
        "clock_hour",
        (F.col("tx_dhour") < F.col("clock_hour")).alias("is_late"),
        (F.col("tx_dhour") <= F.col("clock_hour") - CFG.history_hours).alias("is_expired"),
    )

@query("late_asof")
def late_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features when rows arrive late: a row counts from the batch after its arrival."""
    return _replayed(_late(fx.encoded(spark, sf_dir))).select(
        "tx_id", "batch_seq", *AMOUNT_STATS, *AREA_STATS, *LAST_TX
    )

@query("batch_metrics")
def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per one-hour batch: day, lines in, lines dropped, good lines."""
    parsed = _parsed(spark, sf_dir)
    return parsed.groupBy(F.col("tx_dhour").alias("batch_id")).agg(
        F.call_function("div", F.first("tx_dhour"), F.lit(24)).cast("int").alias("day_no"),
        F.count("*").alias("n_in"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("n_dropped"),
        F.count_if(F.col("reject_reason").isNull()).alias("n_good"),
    )


# --- training sets and schedule ------------------------------------------------------------


@query("train_window_recent")
def train_window_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.tx(spark, sf_dir).select("tx_id", "tx_dhour", "label")
    return training_days(rows, "recent", _last_day(rows), CFG)

@query("train_window_delayed")
def train_window_delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.tx(spark, sf_dir).select("tx_id", "tx_dhour", "label")
    return training_days(rows, "delayed", _last_day(rows), CFG)

@query("train_bags")
def train_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced bags over the whole stream as one training set."""
    return balanced_bags(fx.tx(spark, sf_dir).select("tx_id", "label"), CFG)

@query("model_schedule")
def model_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.call_function("div", F.col("tx_dhour"), F.lit(24)).cast("int")
    return schedule(fx.tx(spark, sf_dir).select(day.alias("day_no")).distinct(), CFG)


# --- vectors and scores --------------------------------------------------------------------


@query("feature_vector")
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_vector(asof_hourly(fx.encoded(spark, sf_dir), CFG), label=True)
    return rows.select("tx_id", *vector_columns(rows), F.col("class"))

@query("score_default")
def score_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unscored(fx.tx(spark, sf_dir).select("tx_id", "cardid"), CFG)


def _votes(model: int) -> list:
    """Ten made-up votes per model, as exact thousandths."""
    return [
        ((F.col("tx_id") * (37 + 20 * model + 2 * tree)) % 1000).cast("double") / F.lit(1000.0)
        for tree in range(CFG.n_tree)
    ]

@query("vote_average")
def vote_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over trees, then over two live models."""
    rows = fx.tx(spark, sf_dir).select("tx_id")
    means = rows.select("tx_id", *[mean_of(_votes(m)).alias(f"pd_{m}") for m in (0, 1)])
    return means.withColumn("pd", mean_of([F.col("pd_0"), F.col("pd_1")]))

@query("ensemble_score")
def ensemble_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.scored(fx.tx(spark, sf_dir))
    return rows.select("tx_id", "pd", "pf", ensemble(F.col("pd"), F.col("pf")).alias("zfraud_pr"))


# --- alerts --------------------------------------------------------------------------------


def _ensembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.scored(fx.tx(spark, sf_dir))
    return rows.withColumn("zfraud_pr", ensemble(F.col("pd"), F.col("pf"))).withColumn(
        "day", F.col("day_no").cast("int")
    )


_ALERT = [
    "tx_rank", "tx_id", "cardid", "day", "tx_datetime", "label", "tx_amount",
    "zfraud_pr", "pd", "pf",
]

@query("batch_top100")
def batch_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of every one-day batch."""
    top = al.top_per_batch(_ensembled(spark, sf_dir), "day", "zfraud_pr", CFG)
    return top.select("day", "place", "tx_id", "zfraud_pr")

@query("daily_alerts")
def daily_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ms(al.daily_ranks(_ensembled(spark, sf_dir), "day", "zfraud_pr", CFG)).select(*_ALERT)

@query("feedback_window")
def feedback_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ensembled(spark, sf_dir)
    ranked = al.daily_ranks(rows, "day", "zfraud_pr", CFG)
    used = al.feedback_days(ranked, rows.agg(F.max("day")).scalar(), CFG)
    return used.select("train_day", "day", "tx_rank", "tx_id", "label")


# --- models --------------------------------------------------------------------------------


def _day() -> Column:
    return F.call_function("div", F.col("tx_dhour"), F.lit(24)).cast("int")


def _delayed_model(rows: DataFrame, day: int):
    """The delayed model of the last day, from feature rows."""
    window = training_days(rows, "delayed", day, CFG).where(F.col("train_day") == day)
    return train_delayed(balanced_bags(window, CFG), CFG, f"delayed-{day}-0", day)


def _feedback_alerts(rows: DataFrame, day: int) -> DataFrame:
    """The riskiest rows of the days before the last one, with features.

    The risk needs no history, so the rows are ranked first, and features are built for the cards
    of the alerts alone: ``alerts_per_day`` rows a day at most, few enough to broadcast.
    """
    scored = rows.withColumns({"risk": F.col("tx_amount") * F.col("cat1"), "day": _day()})
    ranked = al.daily_ranks(scored, "day", "risk", CFG)
    alerts = materialize(
        ranked.where(al.in_feedback_window(F.col("day"), day, CFG)).select("tx_id", "cardid"), "alerts"
    )
    of_cards = rows.join(F.broadcast(alerts.select("cardid").distinct()), "cardid", "left_semi")
    picked = F.broadcast(alerts.select("tx_id"))
    return materialize(asof_hourly(of_cards, CFG).join(picked, "tx_id", "left_semi"), "feedback")

@query("train_delayed")
def train_delayed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per fitted tree its shard, bag, seed, genuine and fraud rows.

    Features are built from the hours that the window's rows can see.
    """
    rows = fx.encoded(spark, sf_dir)
    day = rows.agg(F.max(_day())).first()[0]
    seen = rows.where(F.col("tx_dhour") > day * 24 - 2 * CFG.history_hours)
    model = _delayed_model(asof_hourly(seen, CFG), day)
    kinds = "shard int, bag int, seed int, n_genuine bigint, n_fraud bigint"
    return spark.createDataFrame(list(model.bags) if model else [], kinds)

@query("score_delayed")
def score_delayed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row scored by the delayed model; whether the score is a probability."""
    rows = materialize(asof_hourly(fx.encoded(spark, sf_dir), CFG), "features")
    model = _delayed_model(rows, rows.agg(F.max(_day())).first()[0])
    if model is None:
        scored = unscored(rows, CFG)
    else:
        scored = score_delayed(with_vector(rows), [model])
    return scored.select("tx_id", F.col("zfraud_pr_d").between(0, 1).alias("in_unit"))

@query("train_feedback")
def train_feedback_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of the forest, its training rows, the frauds among them, and its trees."""
    rows = fx.encoded(spark, sf_dir)
    day = rows.agg(F.max(_day())).first()[0]
    alerts = _feedback_alerts(rows, day)
    forest = train_feedback(alerts, CFG)
    facts = alerts.agg(F.count("*").alias("n"), F.count_if("label").alias("f")).first()
    found = [(day, facts["n"], facts["f"], forest.getNumTrees)] if forest else []
    return spark.createDataFrame(found, "day int, n_rows bigint, n_fraud bigint, n_trees int")

@query("score_feedback")
def score_feedback_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row scored by the forest; whether the score is a probability, or -1 for want of one."""
    rows = fx.encoded(spark, sf_dir)
    alerts = _feedback_alerts(rows, rows.agg(F.max(_day())).first()[0])
    scored = score_feedback(with_vector(asof_hourly(rows, CFG)), train_feedback(alerts, CFG))
    score = F.col("zfraud_pr_f")
    return scored.select("tx_id", score.between(0, 1).alias("in_unit"), (score == -1).alias("no_forest"))


# --- the stream ----------------------------------------------------------------------------


@query("stream_replay")
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole stream through the engine, two batches a day; one row per committed batch."""
    return replay(spark, sf_dir, CFG).batch_metrics()


@query("stream_history")
def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a whole run leaves in the history table, with the features they were scored with."""
    rows = _ms(stored_run(spark, sf_dir, CFG).history())
    return rows.select(
        "tx_id", "batch_id", "cardid", "tx_datetime", "tx_dhour", "tx_amount", "boo1", "label",
        "cat1", "cat2", "merchant", "merchantarea", *AMOUNT_STATS, *AREA_STATS, *LAST_TX,
    )

@query("stream_alerts")
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed alert lists of a whole run: places, and whether no score is above that of the place before."""
    alerts = stored_run(spark, sf_dir, CFG).alerts()
    by_rank = Window.partitionBy("day").orderBy("tx_rank")
    before = F.lag("zfraud_pr").over(by_rank)
    falling = F.coalesce(F.col("zfraud_pr") <= before, F.lit(True))
    return alerts.select("day", "tx_rank", falling.alias("falling"))

@query("stream_rejects")
def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that a whole run rejected, by batch and reason."""
    return stored_run(spark, sf_dir, CFG).rejects().select("tx_id", "batch_id", "reject_reason")
