"""Balanced bags."""

from pyspark.sql import functions as F

from cardwarden.config import EngineConfig
from cardwarden.operators.bags import balanced_bags, training_days


def train(spark, genuine, fraud):
    return spark.range(genuine + fraud).select(
        F.col("id").alias("tx_id"), (F.col("id") < fraud).alias("label")
    )


def summary(df):
    out = {}
    for r in df.groupBy("shard", "bag").agg(
        F.count_if(~F.col("label")).alias("g"), F.count_if("label").alias("f")
    ).collect():
        out[(r.shard, r.bag)] = (r.g, r.f)
    return out


def test_every_bag_has_all_frauds(spark):
    bags = summary(balanced_bags(train(spark, 1000, 50), EngineConfig()))
    assert len(bags) == 10 and all(f == 50 for _, f in bags.values())
    assert 30 * 10 < sum(g for g, _ in bags.values()) < 70 * 10


def test_at_least_two_groups(spark):
    bags = summary(balanced_bags(train(spark, 100, 90), EngineConfig()))
    assert len(bags) == 2 and sum(g for g, _ in bags.values()) == 100


def test_no_fraud_gives_two_genuine_bags(spark):
    bags = summary(balanced_bags(train(spark, 60, 0), EngineConfig()))
    assert len(bags) == 2 and all(f == 0 for _, f in bags.values())


def test_small_or_empty_sets_give_nothing(spark):
    assert balanced_bags(train(spark, 10, 5), EngineConfig()).isEmpty()
    assert balanced_bags(train(spark, 0, 0), EngineConfig()).isEmpty()
    assert balanced_bags(train(spark, 0, 9), EngineConfig()).isEmpty()


def test_shards_split_the_genuine_rows_only(spark):
    cfg = EngineConfig(n_shards=3, n_tree=2)
    bags = summary(balanced_bags(train(spark, 3000, 20), cfg))
    assert set(bags) == {(s, b) for s in range(3) for b in range(2)}
    assert all(f == 20 for _, f in bags.values())


def test_layout_does_not_change_the_bags(spark):
    rows = train(spark, 500, 30)
    a = balanced_bags(rows.repartition(1), EngineConfig())
    b = balanced_bags(rows.repartition(7), EngineConfig())
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_training_days_agree_with_the_engine_filters(spark):
    from cardwarden.operators.bags import delayed_window, recent_window

    cfg = EngineConfig()
    rows = spark.range(480).select(F.col("id").alias("tx_id"), F.col("id").cast("int").alias("tx_dhour"))
    hour = F.col("tx_dhour")
    for kind, days in (("recent", [4]), ("delayed", range(8, 20))):
        got = training_days(rows, kind, 19, cfg)
        assert sorted({r.train_day for r in got.select("train_day").distinct().collect()}) == list(days)
        for day in days:
            window = recent_window(hour, day) if kind == "recent" else delayed_window(hour, day, cfg)
            stored = rows.where((hour < 24 * day) & (hour > 24 * day - cfg.history_hours))
            want = {r.tx_id for r in stored.where(window).collect()}
            assert want == {r.tx_id for r in got.where(F.col("train_day") == day).collect()}


def test_bags_of_history_take_the_last_write_once(spark):
    """Copies inside a batch and a second write by a later batch leave one row per key and bag."""
    import datetime as dt

    from cardwarden.operators.bags import bags_of_history

    base = train(spark, 200, 20).select(
        "tx_id", "label", F.concat(F.lit("c"), F.col("tx_id") % 9).alias("cardid"),
        F.col("tx_id").cast("int").alias("tx_dhour"),
        (F.lit(dt.datetime(2024, 1, 1)) + F.expr("make_interval(0,0,0,0,CAST(tx_id AS INT))")).alias("tx_datetime"),
        F.lit(0).cast("bigint").alias("batch_id"), F.lit(1.0).alias("tx_amount"),
    )
    copies = base.where("tx_id = 3").crossJoin(spark.range(500)).drop("id")
    again = base.where("tx_id < 5").withColumn("batch_id", F.lit(7).cast("bigint")).withColumn("tx_amount", F.lit(2.0))
    stored = base.unionByName(copies).unionByName(again)
    for cfg in (EngineConfig(), EngineConfig(broadcast_rows=3)):
        got = bags_of_history(stored, cfg)
        want = summary(balanced_bags(base, cfg))
        assert summary(got) == want
        assert got.where("tx_id < 5 AND tx_amount <> 2.0").isEmpty()
