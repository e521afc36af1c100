"""The daily schedule."""

import pytest

from cardwarden.config import EngineConfig
from cardwarden.plans.schedule import DayPlan, day_plan, live_after, schedule

CFG = EngineConfig()
# day: recent, delayed, close alerts, drop an alert day, feedback
TABLE = {
    0: (0, 0, 0, 0, 0), 3: (0, 0, 0, 0, 0), 4: (1, 0, 0, 0, 0), 5: (0, 0, 1, 0, 0),
    7: (0, 0, 1, 0, 0), 8: (0, 1, 1, 0, 1), 9: (0, 1, 1, 1, 1), 30: (0, 1, 1, 1, 1),
}


@pytest.mark.parametrize("day", TABLE)
def test_each_day(day):
    assert day_plan(day, CFG) == DayPlan(*map(bool, TABLE[day]))


def test_columns_agree_with_numbers(spark):
    days = spark.range(40).selectExpr("CAST(id AS INT) AS day_no")
    for row in schedule(days, CFG).collect():
        assert DayPlan(*row[1:]) == day_plan(row.day_no, CFG)


def test_a_missed_recent_model_is_made_up_for():
    assert day_plan(6, CFG, live_models=0).train_recent
    assert not day_plan(6, CFG, live_models=1).train_recent
    assert not day_plan(3, CFG, live_models=0).train_recent
    assert not day_plan(9, CFG, live_models=0).train_recent


def test_live_models():
    assert live_after(["recent-4", "delayed-8"], CFG) == ["delayed-8"]
    assert live_after(["a", "b", "c"], EngineConfig(train_days=3)) == ["b", "c"]
    assert live_after(["a"], EngineConfig(train_days=1)) == ["a"]
