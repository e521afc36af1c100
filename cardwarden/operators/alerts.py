"""Top risks of a batch and of a day, and the feedback window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwarden.config import EngineConfig


def batch_top(scored: DataFrame, cfg: EngineConfig, score: str = "zfraud_pr") -> DataFrame:
    """The batch's riskiest transactions: a per-task heap, then a merge of the heaps."""
    return scored.orderBy(F.desc(score), "tx_id").limit(cfg.batch_candidates)


def merge_daily(current: DataFrame | None, top: DataFrame, cfg: EngineConfig, score="zfraud_pr"):
    """Add a batch's candidates to the day's list and keep its best."""
    both = top if current is None else current.unionByName(top)
    return both.orderBy(F.desc(score), "tx_id").limit(cfg.alerts_per_day)


def daily_ranks(scored: DataFrame, day: str, score: str, cfg: EngineConfig) -> DataFrame:
    """Rank the riskiest transactions of every day at once.

    The rank bound is part of the query, so Spark cuts each task's rows to that many per day
    before the shuffle: a day that holds most of the data still sends a few rows per task.
    """
    order = Window.partitionBy(day).orderBy(F.desc(score), F.asc("tx_id"))
    return scored.withColumn("tx_rank", F.row_number().over(order)).where(
        F.col("tx_rank") <= cfg.alerts_per_day
    )


def top_per_batch(scored: DataFrame, batch: str, score: str, cfg: EngineConfig) -> DataFrame:
    """The candidates of every batch of a replayed stream, with their place in the batch."""
    order = Window.partitionBy(batch).orderBy(F.desc(score), F.asc("tx_id"))
    return scored.withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= cfg.batch_candidates
    )


def in_feedback_window(alert_day: Column, day: int | Column, cfg: EngineConfig) -> Column:
    return (alert_day >= day - cfg.feedback_days) & (alert_day <= day - 1)


def feedback_days(alerts: DataFrame, last_day: int | Column, cfg: EngineConfig) -> DataFrame:
    """Every (train_day, alert) pair of the whole stream; a projection, as a day decides it."""
    first = cfg.days_before_training + cfg.feedback_days + 1
    last = F.lit(last_day) if isinstance(last_day, int) else last_day
    days = F.sequence(F.col("day") + 1, F.col("day") + cfg.feedback_days)
    used = F.filter(
        days,
        lambda d: (d >= first) & in_feedback_window(F.col("day"), d, cfg),
    )
    return alerts.withColumn("train_day", F.explode(used)).where(F.col("train_day") <= last)
