"""As-of features against brute force, on a small stream with every awkward case."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cardwarden.config import EngineConfig
from cardwarden.operators.asof import asof_batches, asof_hourly, batch_clocks
from cardwarden.operators.history import history_stats
from cardwarden.schema import AMOUNT_STATS, AREA_STATS, LAST_TX

T0 = dt.datetime(2024, 1, 1)
SCHEMA = (
    "tx_id long, cardid string, batch_seq long, tx_dhour int, tx_datetime timestamp, "
    "tx_amount double, boo1 boolean, merchantarea double, cat1 double, cat2 double, merchant double"
)


def stream(seed, hours_per_batch, n=400, late=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        second = rng.randrange(0, 300 * 3600, 900)
        delay = rng.choice([0, 0, 0, 0, 20, 130]) if late else 0
        card = rng.choice(["a", "a", "a", "b", "c", f"r{rng.randrange(20)}"])
        hour = second // 3600
        rows.append(
            (i, card, (hour + delay) // hours_per_batch, hour, T0 + dt.timedelta(seconds=second),
             round(rng.uniform(0, 200), 2), rng.random() < 0.7,
             *[round(rng.random(), 6) for _ in range(4)])
        )
    return rows


def expected(rows, history_hours):
    """Batch by batch, as a store with upserts would see it."""
    batches = {}
    for r in rows:
        batches.setdefault(r[2], []).append(r)
    origin = min(r[4] for r in rows)
    clock, store, out = None, {}, {}
    for seq in sorted(batches):
        first = min(r[4] for r in batches[seq])
        clock = first if clock is None else max(clock, first)
        clock_hour = int((clock - origin).total_seconds()) // 3600
        for r in batches[seq]:
            seen = [h for h in store.values() if h[1] == r[1] and h[3] > clock_hour - history_hours]
            out[r[0]] = features(seen)
        for r in sorted(batches[seq]):
            store[(r[3], r[4], r[1])] = r
    return out


def features(seen):
    if not seen:
        return (0.0,) * 6 + (0,) + (0.0,) * 10
    amount, area = [h[5] for h in seen], [h[7] for h in seen]
    total = float(sum(Decimal(str(a)) for a in amount))
    area_total = float(sum(Decimal(str(a)) for a in area))
    n, last = float(len(seen)), max(seen, key=lambda h: (h[4], h[0]))
    return (
        min(amount), max(amount), max(amount) - min(amount), total, n, total / n,
        sum(not h[6] for h in seen),
        min(area), max(area), max(area) - min(area), area_total, n, area_total / n,
        last[7], last[8], last[9], last[10],
    )


def collected(df):
    cols = AMOUNT_STATS + AREA_STATS + LAST_TX
    return {r.tx_id: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("hours_per_batch, late, hot", [(1, True, 10**6), (6, True, 20), (7, False, 5)])
def test_batches_equal_brute_force(spark, hours_per_batch, late, hot):
    rows = stream(hours_per_batch, hours_per_batch, late=late)
    cfg = EngineConfig(hot_rows=hot, history_hours=120)
    origin = min(r[4] for r in rows).replace(tzinfo=dt.timezone.utc)
    hour0 = int((origin.replace(tzinfo=None) - T0).total_seconds()) // 3600
    rows = [(*r[:3], r[3] - hour0, *r[4:]) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.withColumn("tx_datetime", F.col("tx_datetime"))
    clocks = batch_clocks(df, df.agg(F.min(F.unix_millis("tx_datetime"))).first()[0])
    assert collected(asof_batches(df, clocks, cfg)) == expected(rows, 120)


@pytest.mark.parametrize("hot", [10**6, 3])
def test_hourly_equals_brute_force(spark, hot):
    rows = [r for r in stream(5, 1, n=600, late=False)]
    rows.append((9000, "a", 0, 0, T0, 1.0, True, 0.1, 0.1, 0.1, 0.1))
    df = spark.createDataFrame(rows, SCHEMA)
    got = collected(asof_hourly(df, EngineConfig(hot_rows=hot)))
    assert got == expected(rows, 120)


def test_last_write_counts_once(spark):
    """The same card and second, delivered three times: one stored row, the last one."""
    rows = [
        (1, "a", 0, 0, T0, 10.0, True, 0.1, 0.1, 0.1, 0.1),
        (2, "a", 0, 0, T0, 20.0, False, 0.2, 0.2, 0.2, 0.2),
        (1, "a", 3, 0, T0, 30.0, True, 0.3, 0.3, 0.3, 0.3),
    ]
    stored = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("batch_seq", "batch_id")
    got = history_stats(stored).first()
    assert (got.p_n, got.p_min_tx_amount, got.p_notboo1) == (1, 30.0, 0)


def test_odd_amounts_still_count(spark):
    """An amount no decimal holds is summed as a double instead of being lost."""
    rows = [
        (1, "a", 0, 0, T0, 1e20, True, 0.1, 0.1, 0.1, 0.1),
        (2, "a", 0, 1, T0 + dt.timedelta(hours=1), 5.0, True, 0.1, 0.1, 0.1, 0.1),
        (3, "a", 0, 2, T0 + dt.timedelta(hours=2), 5.0, True, 0.1, 0.1, 0.1, 0.1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.tx_id: r.w1_sum_amount for r in asof_hourly(df, EngineConfig()).collect()}
    assert got == {1: 0.0, 2: 1e20, 3: 1e20 + 5.0}


def test_blocks_are_not_shuffled(spark, monkeypatch):
    """Every exchange of the block merge is by card or below it: a shuffled block is ten rows for one."""
    monkeypatch.setattr("cardwarden.operators.asof.POINTS_PER_TASK", 20)
    rows = stream(5, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    clocks = batch_clocks(df, int(min(r[4] for r in rows).replace(tzinfo=dt.timezone.utc).timestamp() * 1000))
    seen = asof_batches(df, clocks, EngineConfig())
    plan = seen._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffles and not [line for line in shuffles if " k#" in line or " at#" in line or "_node" in line]
    assert seen.count() == len(rows)
