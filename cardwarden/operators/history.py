"""Card history: last write per key, mergeable statistics, last transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwarden.config import EngineConfig
from cardwarden.operators.joins import spread_join
from cardwarden.schema import AMOUNT_STATS, AREA_STATS, HISTORY_KEY, LAST_TX

# What the features need from a stored transaction.
HISTORY_COLUMNS = [
    "cardid", "tx_dhour", "tx_datetime", "tx_amount", "boo1",
    "merchantarea", "cat1", "cat2", "merchant",
]


def latest_per_key(rows: DataFrame, order: list[str], copies: str | None = None) -> DataFrame:
    """Keep the last written row of each (hour, time, card); ``copies`` names a count of the rest.

    A partial aggregate runs before the shuffle, so even a key that was delivered without end
    sends one row per task. With a single order column every buffer is a plain number and Spark
    aggregates by hash; several columns need a struct, for which it sorts.
    """
    rest = [c for c in rows.columns if c not in HISTORY_KEY]
    counted = [F.count("*").alias(copies)] if copies else []
    keyed = rows.groupBy(*HISTORY_KEY)
    if len(order) == 1:
        return keyed.agg(*[F.max_by(c, order[0]).alias(c) for c in rest], *counted)
    kept = keyed.agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"), *counted)
    return kept.select(*HISTORY_KEY, "_last.*", *([copies] if copies else []))


# Columns of the last transaction, and the summed columns with the decimals their sums keep.
_LAST = [c.removeprefix("last_") for c in LAST_TX]
_SUMMED = {"tx_amount": 2, "merchantarea": 6}


def partial_stats() -> list[Column]:
    """Statistics of raw rows, one row per key, that can be merged later.

    Sums run on decimals so that the order of addition cannot change them. Values too large for
    a decimal are added as doubles in ``p_odd_*``. Values that are not finite count as rows but
    enter no minimum, maximum or sum, so one odd line does not spoil its card's later rows. A
    card's stored rows differ in time, so time alone decides the last one.
    """
    out = {"p_n": "count(*)", "p_notboo1": "count_if(NOT boo1)", "p_at": "max(tx_datetime)"}
    for col, scale in _SUMMED.items():
        dec = f"try_cast({col} AS DECIMAL(18,{scale}))"
        finite = f"CASE WHEN abs({col}) < double('Infinity') THEN {col} END"
        out |= {
            f"p_min_{col}": f"min({finite})",
            f"p_max_{col}": f"max({finite})",
            f"p_sum_{col}": f"sum({dec})",
            f"p_odd_{col}": f"sum(CASE WHEN {dec} IS NULL THEN {finite} END)",
        }
    out |= {f"p_last_{c}": f"max_by({c}, tx_datetime)" for c in _LAST}
    return [F.expr(sql).alias(name) for name, sql in out.items()]


def _merge_sql() -> dict[str, str]:
    out = {"p_n": "sum(p_n)", "p_notboo1": "sum(p_notboo1)"}
    for col in _SUMMED:
        out |= {
            f"p_min_{col}": f"min(p_min_{col})",
            f"p_max_{col}": f"max(p_max_{col})",
            f"p_sum_{col}": f"sum(p_sum_{col})",
            f"p_odd_{col}": f"sum(p_odd_{col})",
        }
    return out


def merged() -> list[Column]:
    """Merge partial statistics."""
    out = _merge_sql() | {f"p_last_{c}": f"max_by(p_last_{c}, p_at)" for c in _LAST}
    out["p_at"] = "max(p_at)"
    return [F.expr(sql).alias(name) for name, sql in out.items()]


_HIGH = 1_000_000_000  # sums are cut into whole multiples of this and the rest


def merged_over_hours(hourly: DataFrame, hours: int) -> DataFrame:
    """Per card and hour: statistics merged over the ``hours`` before it.

    A frame adds its rows anew for every hour, so the decimal sums enter it as two integers each,
    and the last transaction is simply that of the card's previous hour, if near enough.
    """
    cut = ["*"]
    for col, scale in _SUMMED.items():
        cut += [
            f"p_sum_{col} DIV {_HIGH} AS _high_{col}",
            f"CAST((p_sum_{col} % {_HIGH}) * {10**scale} AS BIGINT) AS _low_{col}",
        ]
    sums = _merge_sql()
    for col in _SUMMED:
        del sums[f"p_sum_{col}"]
        sums |= {f"_high_{col}": f"sum(_high_{col})", f"_low_{col}": f"sum(_low_{col})"}
    over = f"OVER (PARTITION BY cardid ORDER BY tx_dhour RANGE BETWEEN {hours} PRECEDING AND 1 PRECEDING)"
    lag = "OVER (PARTITION BY cardid ORDER BY tx_dhour)"
    framed = hourly.selectExpr(*cut).selectExpr(
        "cardid",
        "tx_dhour",
        *[f"{sql} {over} AS {name}" for name, sql in sums.items()],
        f"lag(tx_dhour) {lag} AS _hour",
        *[f"lag(p_last_{c}) {lag} AS _last_{c}" for c in _LAST],
    )
    keep = [n for n in sums if not n.startswith("_")]
    whole = [
        f"CAST(_high_{col} AS DECIMAL(19,0)) * {_HIGH}BD"
        f" + CAST(_low_{col} AS DECIMAL(19,0)) * {1 / 10**scale:.{scale}f}BD AS p_sum_{col}"
        for col, scale in _SUMMED.items()
    ]
    last = [f"CASE WHEN tx_dhour - _hour <= {hours} THEN _last_{c} END AS p_last_{c}" for c in _LAST]
    return framed.selectExpr("cardid", "tx_dhour", *keep, *whole, *last)


def finished() -> list[str]:
    """The published features from merged statistics, as SQL; all zero without any history."""
    n = "CAST(coalesce(p_n, 0) AS DOUBLE)"
    out = {"w1_countboo1false": "CAST(coalesce(p_notboo1, 0) AS INT)"}
    for col, name in (("tx_amount", "amount"), ("merchantarea", "merchantarea")):
        low, high = f"coalesce(p_min_{col}, 0D)", f"coalesce(p_max_{col}, 0D)"
        total = f"(coalesce(CAST(p_sum_{col} AS DOUBLE), 0D) + coalesce(p_odd_{col}, 0D))"
        out |= {
            f"w1_min_{name}": low,
            f"w1_max_{name}": high,
            f"w1_mmdif_{name}": f"{high} - {low}",
            f"w1_sum_{name}": total,
            f"w1_count_{name}": n,
            f"w1_avg_{name}": f"{total} / greatest({n}, 1D)",
        }
    out |= {name: f"coalesce(p_{name}, 0D)" for name in LAST_TX}
    return [f"{out[c]} AS {c}" for c in AMOUNT_STATS + AREA_STATS + LAST_TX]


def batch_cards(batch: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The distinct cards of a batch, with their number of rows."""
    return batch.groupBy(*by, "cardid").agg(F.count("*").cast("bigint").alias("batch_rows"))


def stored_counts(history: DataFrame, cards: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows that the history holds of each of the batch's cards, counted before any join."""
    keys = [*by, "cardid"]
    held = history.groupBy(*keys).agg(F.count("*").alias("stored_rows"))
    return held.join(cards.select(*keys), keys, "left_semi")


def of_batch_cards(
    history: DataFrame,
    cards: DataFrame,
    small: bool,
    hot: DataFrame | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """History of the batch's cards only, before anything is aggregated.

    Cards counted as few are broadcast; else both sides are shuffled, the ``hot`` cards salted:
    those of which the history holds many rows, however few the batch has.
    """
    keys = [*by, "cardid"]
    if small:
        return history.join(F.broadcast(cards.select(*keys)), keys, "left_semi")
    return spread_join(history, cards.select(*keys), keys, "tx_id", hot, "left_semi")


def rolled_stats(rolled: DataFrame, one_task: bool = False) -> DataFrame:
    """One row per card from (card, hour) statistics in versions; the last version of an hour counts.

    A card has a row per retained hour and version, however many transactions it made in them, so
    one shuffle by card serves both steps, and none if the rows come from ``one_task``.
    """
    parts = [c for c in rolled.columns if c.startswith("p_")]
    if not one_task:
        rolled = rolled.repartition("cardid")
    last = rolled.groupBy("cardid", "tx_dhour").agg(*[F.expr(f"max_by({c}, batch_id)").alias(c) for c in parts])
    return last.groupBy("cardid").agg(*merged())


def history_stats(history: DataFrame) -> DataFrame:
    """One row per card: merged statistics of its stored transactions."""
    latest = latest_per_key(
        history.select("tx_id", "batch_id", *HISTORY_COLUMNS), ["batch_id", "tx_id"]
    )
    return latest.groupBy("cardid").agg(*partial_stats())
