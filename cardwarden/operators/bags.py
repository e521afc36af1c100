"""Training windows and balanced bags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwarden.config import EngineConfig
from cardwarden.functions.hashing import bucket
from cardwarden.operators.history import latest_per_key
from cardwarden.operators.joins import fits_broadcast
from cardwarden.schema import HISTORY_KEY
from cardwarden.session import few_bytes, materialize

_SHARD_DIGITS = 9  # other hash digits than the bags use, so the two stay independent


def recent_window(hour: Column, day: int | Column) -> Column:
    """Hours of the day before ``day`` and later, its first hour excluded."""
    return hour > (day - 1) * 24


def delayed_window(hour: Column, day: int | Column, cfg: EngineConfig) -> Column:
    """Hours old enough for their labels to be known on ``day``."""
    return hour < (day - cfg.delay_days) * 24


def training_days(rows: DataFrame, kind: str, last_day: int | Column, cfg: EngineConfig):
    """Every (train_day, row) pair of the whole stream for one kind of model.

    The days that use a row follow from its hour alone, so this is one projection: no join, and
    a row is repeated at most once per day of retention. Each day is taken at its first hour,
    with the retention rule applied and only earlier hours stored.
    """
    hour = F.col("tx_dhour")
    first = cfg.days_before_training + 1
    if kind == "recent":
        days = F.sequence(F.lit(first), F.lit(cfg.days_before_training + cfg.train_days - 1))
        keep = lambda d: recent_window(hour, d)
    elif kind == "delayed":
        low = F.call_function("div", hour, F.lit(24)).cast("int")
        days = F.sequence(low, low + F.lit(cfg.history_hours // 24 + 1))
        begin = cfg.days_before_training + cfg.delay_days + cfg.train_days
        keep = lambda d: (d > begin) & delayed_window(hour, d, cfg)
    else:
        raise ValueError(f"unknown kind of training window: {kind}")
    last = F.lit(last_day) if isinstance(last_day, int) else last_day
    used = F.filter(
        days,
        lambda d: keep(d) & (hour < d * 24) & (hour > d * 24 - F.lit(cfg.history_hours)),
    )
    return rows.withColumn("train_day", F.explode(used)).where(F.col("train_day") <= last)


def with_shard(train: DataFrame, cfg: EngineConfig) -> DataFrame:
    return train.withColumn("shard", bucket(F.col("tx_id"), cfg.n_shards, _SHARD_DIGITS))


def bag_plan(sharded: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Per shard: class counts, number of groups, number of bags used. ``n_shards`` rows at most."""
    counts = sharded.groupBy("shard").agg(
        F.count_if(~F.col("label")).alias("n_genuine"), F.count_if("label").alias("n_shard_fraud")
    )
    n_fraud = F.sum("n_shard_fraud").over(Window.partitionBy(F.lit(0)))
    wanted = F.call_function(
        "div", F.col("n_genuine"), F.nullif(F.col("n_fraud") * cfg.genuine_per_fraud, F.lit(0))
    )
    return (
        counts.withColumn("n_fraud", n_fraud)
        .where(F.col("n_genuine") > cfg.min_shard_rows)
        .withColumn("n_groups", F.greatest(F.lit(2), F.coalesce(wanted, F.lit(0))).cast("int"))
        .withColumn("n_bags", F.least(F.lit(cfg.n_tree), F.col("n_groups")))
        .select("shard", "n_genuine", "n_fraud", "n_groups", "n_bags")
    )


def balanced_bags(train: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Rows with ``shard`` and ``bag``: each bag has its genuine share and every fraud.

    The plan has at most ``n_shards`` rows by construction, so it is broadcast to the genuine
    rows, and the frauds repeat themselves over its bags; nothing but the counts is shuffled.
    """
    sharded = with_shard(train, cfg)
    plan = bag_plan(sharded, cfg)
    genuine = (
        sharded.where("NOT label")
        .join(F.broadcast(plan.select("shard", "n_groups", "n_bags")), "shard")
        .withColumn("bag", bucket(F.col("tx_id"), F.col("n_groups")))
        .where("bag < n_bags")
        .drop("n_groups", "n_bags")
    )
    bags = plan.select("shard", F.explode(F.expr("sequence(0, n_bags - 1)")).alias("bag"))
    every = bags.agg(F.collect_list(F.struct("shard", "bag"))).scalar()
    fraud = (
        sharded.where("label")
        .drop("shard")
        .withColumn("_bags", every)
        .select("*", F.inline("_bags"))
        .drop("_bags")
    )
    return genuine.unionByName(fraud)


def bags_of_history(stored: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Balanced bags of stored rows, last write per key.

    The bags are drawn on keys and labels alone. Only the drawn keys, a small part of the window
    when frauds are rare, are then looked up in the wide rows, in one scan. Where all rows are few,
    the wide rows are folded at once, which saves the two passes that look the keys up.
    """
    if few_bytes(stored):
        rows = materialize(latest_per_key(stored, ["batch_id", "tx_id"]), "training-rows")
        return balanced_bags(rows, cfg)
    on = [*HISTORY_KEY, "batch_id", "tx_id"]
    keys = materialize(
        latest_per_key(stored.select(*on, "label"), ["batch_id", "tx_id"]), "training-keys"
    )
    drawn = materialize(balanced_bags(keys, cfg).drop("label"), "drawn")
    small = fits_broadcast(drawn, cfg.broadcast_rows)
    drawn = F.broadcast(drawn) if small else drawn
    # Copies of a drawn row are folded before it is repeated for its bags.
    wide = stored.join(drawn.select(*on), on, "left_semi")
    return latest_per_key(wide, ["batch_id", "tx_id"]).join(drawn, on)
