"""Rates meet goals that can be met; others end at the least squares and are reported."""

import numpy as np
import pytest

import corpus_pipeline
from cardwarden.llm import mixing


def table(spark, seed, alpha, n=400):
    rng = np.random.default_rng(seed)
    p, n = rng.dirichlet(alpha, n), rng.integers(0, 900, n)
    rows = [(int(k), *map(float, q)) for k, q in zip(n, p)]
    return p, n, spark.createDataFrame(rows, "n long, p0 double, p1 double, p2 double").cache()


def rates(members, found):
    return np.array([r[0] for r in members.select(mixing.rate_of(found)).collect()])


@pytest.mark.parametrize("shares", [(0.3, 0.65, 0.05), (0.6, 0.05, 0.35)])
def test_far_goals_are_met(spark, shares):
    p, n, members = table(spark, 1, [2, 1, 0.5])
    goal = np.array(shares) * n.sum()
    found, reached = mixing.fit_rates(members, goal)
    r = rates(members, found)
    assert r.min() == 0 and np.allclose((r * n) @ p, reached) and np.abs(reached - goal).max() < 1e-5 * n.sum()


def test_goals_out_of_reach_end_at_the_least_squares(spark):
    p, n, members = table(spark, 2, [6, 3, 2])
    goal = np.array([0.9, 0.1, 0.0]) * n.sum()
    found, reached = mixing.fit_rates(members, goal, rounds=100)
    r = rates(members, found)
    push = p[n > 0] @ (reached - goal) / n.sum()
    assert np.abs(reached - goal).max() > 1e-2 * n.sum()
    # No rate above 0 gains by a change, none at 0 by a rise.
    assert np.abs(np.where(r[n > 0] > 0, push, np.minimum(push, 0))).max() < 1e-5


@pytest.mark.parametrize("shares", [(0.5, 0.4, 0.1), (0.9, 0.1, 0.0)])
def test_gradient_rounds_equal_numpy(spark, shares):
    p, n, members = table(spark, 4, [3, 2, 1], n=60)
    goal = np.array(shares) * n.sum()
    found, reached = mixing.fit_rates(members, goal, rounds=0, polish=12)
    r, curve = np.ones(60), float((n[:, None] * p * p).sum())
    misses = []
    for _ in range(12):
        off = (r * n) @ p - goal
        misses.append(off @ off)
        r = np.maximum(0, r - p @ off / curve)
    assert np.allclose(rates(members, found), r, atol=1e-9) and np.allclose(reached, (r * n) @ p)
    assert len(found) == 13 and all(a > b for a, b in zip(misses, misses[1:]))


def test_a_free_domain_and_unmet_targets_show(spark):
    p, n, members = table(spark, 3, [6, 3, 0.2])
    goal = np.array([0.9 * n.sum(), 0.1 * n.sum(), np.nan])
    found, reached = mixing.fit_rates(members, goal)
    assert np.abs(reached - goal)[:2].max() < 1e-5 * n.sum() and rates(members, found).min() >= 0
    assert set(corpus_pipeline.TARGETS) == {"good", "poor"}
    docs = spark.createDataFrame([(1, "some words of a text"), (2, "and more of them")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    with pytest.warns(UserWarning, match="reached"):
        rows = mixing.mix_documents(docs, none).collect()
    assert [x.targets_met for x in rows] == [False, False]
    rows = mixing.mix_documents(docs, none, {"good": 1, "poor": 1}).collect()
    assert [x.targets_met for x in rows] == [True, True] and all(abs(x.rate - 1) < 1e-6 for x in rows)
