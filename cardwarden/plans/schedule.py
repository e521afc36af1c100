"""What each new day does. One set of conditions serves a number and a column of days."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwarden.config import EngineConfig


def conditions(day, cfg: EngineConfig) -> dict:
    """Actions of a day roll, in the order they run; ``day`` may be an int or a Column."""
    warm = cfg.days_before_training
    started = day > warm
    return {
        "train_recent": started & (day < warm + cfg.train_days),
        "train_delayed": started & (day > warm + cfg.delay_days + cfg.train_days),
        "close_alerts": started & (day > warm + 1),
        "drop_alert_day": started & (day > warm + 1 + cfg.feedback_days),
        "train_feedback": started & (day > warm + cfg.feedback_days),
    }


@dataclass(frozen=True)
class DayPlan:
    train_recent: bool
    train_delayed: bool
    close_alerts: bool
    drop_alert_day: bool
    train_feedback: bool


def day_plan(day: int, cfg: EngineConfig, live_models: int = 1) -> DayPlan:
    """The actions of one day roll.

    If the day of the recent model was missing from the stream, no model is live; then the
    recent model is made up for on the next day that does not train a delayed one.
    """
    plan = conditions(day, cfg)
    if day > cfg.days_before_training and live_models == 0 and not plan["train_delayed"]:
        plan["train_recent"] = True
    return DayPlan(**plan)


def live_after(models: list, cfg: EngineConfig) -> list:
    """Drop the oldest models beyond the number that stays live."""
    return models[-cfg.live_delayed_models :]


def schedule(days: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The actions of every day in ``days`` (column ``day_no``)."""
    named = conditions(F.col("day_no"), cfg)
    return days.select("day_no", *[c.alias(n) for n, c in named.items()])
