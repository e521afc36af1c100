"""As-of card features for a whole replayed stream: each batch sees earlier batches only.

Both forms first reduce the transactions to one row of mergeable statistics per card and hour
(and batch). Everything that needs the rows of a card in one place works on those, whose number
is bounded by elapsed time; the transactions themselves are only joined to the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardwarden.config import EngineConfig
from cardwarden.operators.history import (
    HISTORY_COLUMNS,
    finished,
    latest_per_key,
    merged,
    merged_over_hours,
    partial_stats,
)
from cardwarden.operators.joins import fits_broadcast, hot_keys, spread_join
from cardwarden.session import materialize


#: (card, batch) pairs of one task, whose blocks, about ten of each, should fit in its memory.
POINTS_PER_TASK = 25_000


def _attach(rows: DataFrame, feats: DataFrame, counts: DataFrame, keys: list[str], cfg):
    hot = hot_keys(counts, keys, "rows", cfg.hot_rows, cfg.broadcast_rows)
    joined = spread_join(rows, feats, keys, "tx_id", hot)
    return joined.selectExpr(*rows.columns, *finished())


def asof_hourly(tx: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Features of one-hour batches: the preceding retained hours, the own hour excluded."""
    stored = latest_per_key(tx.select("tx_id", *HISTORY_COLUMNS), ["tx_id"], copies="copies")
    hourly = materialize(
        stored.groupBy("cardid", "tx_dhour").agg(*partial_stats(), F.sum("copies").alias("rows")),
        "hourly",
    )
    feats = merged_over_hours(hourly, cfg.history_hours - 1)
    return _attach(tx, feats, hourly, ["cardid", "tx_dhour"], cfg)


def batch_clocks(rows: DataFrame, origin_ms) -> DataFrame:
    """One row per batch: its first time and the clock, which never moves back.

    The running maximum goes over one row per batch, so its size follows elapsed time only. It
    still runs in two steps, inside blocks of batches and then over the blocks.
    """
    firsts = rows.groupBy("batch_seq").agg(
        F.min(F.unix_millis("tx_datetime")).alias("first_ms"), F.count("*").alias("n_rows")
    )
    block = F.call_function("div", F.col("batch_seq"), F.lit(1024))
    firsts = firsts.withColumn("_block", block)
    inside = Window.partitionBy("_block").orderBy("batch_seq").rowsBetween(
        Window.unboundedPreceding, 0
    )
    before = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = (
        firsts.groupBy("_block")
        .agg(F.max("first_ms").alias("_m"))
        .select("_block", F.max("_m").over(before).alias("_carried"))
    )
    gap = F.col("clock_ms") - (F.lit(origin_ms) if isinstance(origin_ms, int) else origin_ms)
    return (
        firsts.withColumn("_running", F.max("first_ms").over(inside))
        .join(carried, "_block")
        .withColumn("clock_ms", F.greatest("_running", "_carried"))
        .select(
            F.col("batch_seq").cast("bigint").alias("batch_seq"),
            "n_rows",
            "first_ms",
            "clock_ms",
            F.call_function("div", gap, F.lit(3_600_000)).cast("int").alias("clock_hour"),
            F.call_function("div", gap, F.lit(86_400_000)).cast("int").alias("clock_day"),
        )
    )


def _expiry(clocks: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Per relative hour, the first batch that no longer sees transactions of that hour.

    One row per hour from one row per batch; neither grows with the transactions.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("batch_seq")
    passed = clocks.select(
        "batch_seq",
        F.col("clock_hour").alias("_to"),
        F.coalesce(F.lag("clock_hour").over(order) + 1, F.col("clock_hour")).alias("_from"),
    ).where("_from <= _to")
    hours = passed.select(
        F.col("batch_seq").alias("_gone"), F.explode(F.sequence("_from", "_to")).alias("_hour")
    )
    return hours.select((F.col("_hour") - F.lit(cfg.history_hours)).alias("tx_dhour"), "_gone")


def asof_batches(tx: DataFrame, clocks: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Features of every transaction, for batches of any length and for late rows."""
    counts, feats = _card_batches(tx, clocks, cfg)
    return _attach(tx, feats, counts, ["cardid", "batch_seq"], cfg)


def card_stats(tx: DataFrame, clocks: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Features per batch and card, zero for a card without history."""
    counts, feats = _card_batches(tx, clocks, cfg)
    keys = ["batch_seq", "cardid"]
    return counts.select(*keys).join(feats, keys, "left").selectExpr(*keys, *finished())


def _card_batches(tx: DataFrame, clocks: DataFrame, cfg: EngineConfig):
    """The (card, batch) pairs with their number of rows, and their merged statistics.

    A stored row is seen by an unbroken run of batches: from the one after its own to the one
    whose clock expires its hour. Each run is cut into aligned blocks of 2^k batches, at most two
    per size; a batch then merges the one block of each size that contains it. Work grows with
    the logarithm of the run, and no pair of rows of a card is ever formed.

    Runs and batches are dealt out by card before they are cut into blocks, so that blocks, many a
    row, are merged and handed to their batches where they are made and never shuffled. A card has
    at most one run per hour and batch by then, however many transactions it made.
    """
    clocks = materialize(clocks, "clocks")
    first = clocks.agg(F.min("batch_seq"), F.min("clock_hour"), F.max("batch_seq")).first()
    first_seq, first_hour, top = (v or 0 for v in first)
    levels = max(1, int(top + 1).bit_length())
    stored = _upserts(tx)
    hourly = stored.groupBy("cardid", "batch_seq", "until", "tx_dhour").agg(*partial_stats())

    gone = _expiry(clocks, cfg)
    small = fits_broadcast(gone, cfg.broadcast_rows)
    # Hours that had expired before the first batch are in no run at all.
    never = F.when(F.col("tx_dhour") <= first_hour - cfg.history_hours, F.lit(first_seq))
    runs = (
        hourly.join(F.broadcast(gone) if small else gone, "tx_dhour", "left")
        .withColumn("_last_seen", F.coalesce(F.col("_gone"), never) - 1)
        .withColumn("_hi", F.least(F.lit(top), "_last_seen", "until"))
        .withColumn("_lo", F.col("batch_seq") + 1)
        .where("_lo <= _hi")
    )
    blocks = []
    for k in range(levels):
        size = 1 << k
        left = F.call_function("div", F.col("_lo") + (size - 1), F.lit(size))
        right = F.call_function("div", F.col("_hi") + 1, F.lit(size))
        level = F.lit(k)
        blocks.append(
            F.when((left < right) & (left % 2 == 1), F.struct(level.alias("k"), left.cast("bigint").alias("at")))
        )
        blocks.append(
            F.when(
                (left < right) & (right % 2 == 1),
                F.struct(level.alias("k"), (right - 1).cast("bigint").alias("at")),
            )
        )
    seq = F.col("batch_seq").cast("bigint").alias("batch_seq")
    counts = materialize(tx.groupBy("cardid", seq).agg(F.count("*").alias("rows")), "points")
    n_points = counts.count()
    parts = [c for c in hourly.columns if c.startswith("p_")]
    cut = runs.select("cardid", F.array_compact(F.array(*blocks)).alias("_nodes"), *parts)
    every = F.expr(
        f"transform(sequence(0, {levels - 1}), k -> struct(k AS k, shiftright(batch_seq, k) AS at))"
    )
    points = counts.where("batch_seq IS NOT NULL").select(
        "cardid", every.alias("_nodes"), F.col("batch_seq").alias("_seq")
    )
    n_parts = max(tx.sparkSession.sparkContext.defaultParallelism, n_points // POINTS_PER_TASK + 1)
    dealt = cut.unionByName(points, allowMissingColumns=True).repartition(n_parts, "cardid")
    nodes = (
        dealt.select("cardid", "_seq", *parts, F.explode("_nodes").alias("_node"))
        .select("cardid", "_seq", *parts, F.col("_node.k").alias("k"), F.col("_node.at").alias("at"))
        .groupBy("cardid", "k", "at")
        .agg(*merged(), F.collect_list("_seq").alias("_seqs"))
        .where("p_n IS NOT NULL")
    )
    feats = (
        nodes.select("cardid", *parts, F.explode("_seqs").alias("batch_seq"))
        .groupBy("cardid", "batch_seq")
        .agg(*merged())
    )
    return counts, feats


def _upserts(tx: DataFrame) -> DataFrame:
    """Stored versions of each key with the last batch that sees them (``until``, null if open).

    Within a batch the highest id wins. A key written again by a later batch is replaced from
    the batch after that one on; such repeats are rare, so the window partitions are tiny, and
    the first step has already collapsed endless copies inside a batch.
    """
    key = ["tx_dhour", "tx_datetime", "cardid"]
    rest = ["tx_id", *[c for c in HISTORY_COLUMNS if c not in key]]
    once = (
        tx.groupBy(*key, F.col("batch_seq").cast("bigint").alias("batch_seq"))
        .agg(F.max_by(F.struct(*rest), F.col("tx_id")).alias("_r"))
        .select(*key, "batch_seq", "_r.*")
    )
    order = Window.partitionBy(*key).orderBy("batch_seq")
    return once.withColumn("until", F.lead("batch_seq").over(order))
