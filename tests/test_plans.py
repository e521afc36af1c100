"""The physical plans hold what large data needs."""

import pytest
from pyspark.sql import functions as F

from cardwarden.config import EngineConfig
from cardwarden.operators.alerts import batch_top
from cardwarden.plans import fixtures as fx
from cardwarden.plans.queries import REGISTRY

BATCH = sorted(set(REGISTRY) - {"stream_replay", "train_delayed", "score_delayed", "train_feedback", "score_feedback"})


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_single_task_data_window(spark, sf_dir, name):
    text = plan(REGISTRY[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["daily_alerts", "batch_top100", "feedback_window"])
def test_ranks_are_cut_before_the_shuffle(spark, sf_dir, name):
    text = plan(REGISTRY[name](spark, sf_dir))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_batch_top_is_a_heap(spark, sf_dir):
    rows = fx.scored(fx.tx(spark, sf_dir)).withColumn("zfraud_pr", F.col("pd"))
    assert "TakeOrderedAndProject" in plan(batch_top(rows, EngineConfig()))


def test_aggregates_combine_before_the_shuffle(spark, sf_dir):
    assert "partial_max_by" in plan(REGISTRY["dedupe_key"](spark, sf_dir))
    assert "partial_count" in plan(REGISTRY["batch_cards"](spark, sf_dir))
