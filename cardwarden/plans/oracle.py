"""Expected results of the registered queries, as SQL over the given tables."""

from __future__ import annotations

from cardwarden.schema import AMOUNT_STATS, AREA_STATS, FEATURES, LAST_TX

_TX = """
WITH ev AS (
  SELECT event_id, ts, user_id, event_type, value,
    CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events
), tx AS (
  SELECT event_id AS tx_id, CAST(user_id AS VARCHAR) AS cardid, k, event_type AS cat1_level,
    'c' || CAST(k % 5 AS VARCHAR) AS cat2_level, 'm' || CAST(k AS VARCHAR) AS merchant_level,
    'a,' || CAST(CAST(floor(k / 10) AS INT) AS VARCHAR) AS merchantarea_level,
    value AS tx_amount, date_trunc('second', ts) AS tx_datetime,
    epoch_ms(date_trunc('second', ts)) AS tx_ms,
    event_type <> 'view' AS boo1, event_id % 2 = 0 AS boo2,
    CAST(18 + user_id % 60 AS INT) AS age, CAST(user_id % 20 AS INT) AS nationality,
    CAST(user_id % 3 AS INT) AS gender, CAST(k % 7 AS INT) AS cat3,
    CAST(event_id % 7 AS INT) AS cat4, event_type = 'error' AND value >= 100 AS label,
    CAST(floor((epoch_us(date_trunc('second', ts))
      - (SELECT min(epoch_us(date_trunc('second', ts))) FROM ev)) / 3600000000) AS INT) AS tx_dhour,
    CAST(hour(ts) AS INT) AS tx_hour, CAST(dayofweek(ts) + 1 AS INT) AS tx_dayw
  FROM ev
)"""

_DICT = (
    _TX
    + """, dictionary AS (
  SELECT 'cat1' AS variable, 0 AS id, cat1_level AS level,
    round(avg(CAST(label AS INT)), 6) AS risk FROM tx GROUP BY cat1_level
  UNION ALL SELECT 'cat2', 0, cat2_level, round(avg(CAST(label AS INT)), 6)
    FROM tx GROUP BY cat2_level
  UNION ALL SELECT 'merchant', 0, merchant_level, round(avg(CAST(label AS INT)), 6)
    FROM tx GROUP BY merchant_level
  UNION ALL SELECT 'TERM_COUNTRY', 0, merchantarea_level, round(avg(CAST(label AS INT)), 6)
    FROM tx GROUP BY merchantarea_level
  UNION ALL SELECT DISTINCT 'nationality', nationality, 'n' || CAST(nationality AS VARCHAR), 0.0
    FROM tx
  UNION ALL SELECT DISTINCT 'GENDER', gender, 'g' || CAST(gender AS VARCHAR), 0.0 FROM tx
  UNION ALL SELECT DISTINCT 'cat3', cat3, 't' || CAST(cat3 AS VARCHAR), 0.0 FROM tx
  UNION ALL SELECT DISTINCT 'cat4', cat4, 'u' || CAST(cat4 AS VARCHAR), 0.0 FROM tx
)"""
)

_ENCODED = (
    _DICT
    + """, enc AS (
  SELECT tx.*, d1.risk AS cat1, d2.risk AS cat2, d3.risk AS merchant, d4.risk AS merchantarea
  FROM tx
  JOIN dictionary d1 ON d1.variable = 'cat1' AND d1.level = cat1_level
  JOIN dictionary d2 ON d2.variable = 'cat2' AND d2.level = cat2_level
  JOIN dictionary d3 ON d3.variable = 'merchant' AND d3.level = merchant_level
  JOIN dictionary d4 ON d4.variable = 'TERM_COUNTRY' AND d4.level = merchantarea_level
)"""
)


def _stats(source: str, by: str, h: str = "h") -> str:
    """Aggregates over joined history rows ``h``; ``by`` are the grouping columns."""
    last = ", ".join(
        f"coalesce(arg_max({h}.{c}, row({h}.tx_datetime, {h}.tx_id)), 0) AS last_{c}"
        for c in ("merchantarea", "cat1", "cat2", "merchant")
    )
    parts = []
    for col, name, scale in (("tx_amount", "amount", 2), ("merchantarea", "merchantarea", 6)):
        low, high = f"coalesce(min({h}.{col}), 0)", f"coalesce(max({h}.{col}), 0)"
        total = f"coalesce(CAST(sum(CAST({h}.{col} AS DECIMAL(18,{scale}))) AS DOUBLE), 0)"
        n = f"CAST(count({h}.tx_id) AS DOUBLE)"
        parts += [
            f"{low} AS w1_min_{name}",
            f"{high} AS w1_max_{name}",
            f"{high} - {low} AS w1_mmdif_{name}",
            f"{total} AS w1_sum_{name}",
            f"{n} AS w1_count_{name}",
            f"{total} / greatest({n}, 1.0::DOUBLE) AS w1_avg_{name}",
        ]
    notboo1 = f"CAST(count({h}.tx_id) FILTER (NOT {h}.boo1) AS INT) AS w1_countboo1false"
    return f"SELECT {by}, {', '.join(parts)}, {notboo1}, {last} {source} GROUP BY {by}"


# One row per stored key: the highest id of a card's second.
_STORED = """, stored AS (
  SELECT * FROM enc QUALIFY row_number() OVER (
    PARTITION BY cardid, tx_dhour, tx_datetime ORDER BY tx_id DESC) = 1
)"""

_HOURLY = (
    _ENCODED
    + _STORED
    + ", feats AS ("
    + _stats(
        "FROM enc b LEFT JOIN stored h ON h.cardid = b.cardid "
        "AND h.tx_dhour BETWEEN b.tx_dhour - 119 AND b.tx_dhour - 1",
        "b.tx_id",
    )
    + ")"
)


def _batches(hours: int) -> str:
    """As-of features of batches of ``hours`` hours, whose clock is their earliest hour."""
    return (
        _ENCODED
        + _STORED
        + f""", clocks AS (
  SELECT tx_dhour // {hours} AS batch_seq, min(tx_dhour) AS clock_hour FROM enc GROUP BY 1
), feats AS ("""
        + _stats(
            f"FROM enc b JOIN clocks c ON c.batch_seq = b.tx_dhour // {hours} "
            f"LEFT JOIN stored h ON h.cardid = b.cardid AND h.tx_dhour // {hours} < c.batch_seq "
            "AND h.tx_dhour > c.clock_hour - 120",
            "b.tx_id, c.batch_seq, b.cardid",
        )
        + ")"
    )


_DAILY = _batches(24)
_FEATS = ", ".join(AMOUNT_STATS + AREA_STATS + LAST_TX)

_LATE = """, arr AS (
  SELECT *, CAST(tx_dhour + CASE WHEN tx_id % 50 = 0 THEN 150 WHEN tx_id % 20 = 0 THEN 30
    ELSE 0 END AS BIGINT) AS batch_seq FROM {source}
), firsts AS (
  SELECT batch_seq, min(tx_ms) AS first_ms FROM arr GROUP BY batch_seq
), clocks AS (
  SELECT batch_seq, CAST((max(first_ms) OVER (ORDER BY batch_seq)
    - (SELECT min(tx_ms) FROM arr)) // 3600000 AS INT) AS clock_hour FROM firsts
)"""

_GOOD = "tx_id % 97 <> 0 AND tx_id % 89 <> 0"

_SCORED = (
    _TX
    + """, parts AS (
  SELECT tx_id, cardid, tx_ms AS tx_datetime, tx_dhour,
    CAST(floor(tx_dhour / 24) AS INT) AS "day", label, tx_amount,
    CAST(tx_id * 37 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS pd,
    CASE WHEN tx_dhour < 192 THEN CAST(-1 AS DOUBLE)
      ELSE CAST(tx_id * 91 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS pf
  FROM tx
), scored AS (
  SELECT *, CASE WHEN pf >= 0 THEN CAST(0.5 AS DOUBLE) * pd + CAST(0.5 AS DOUBLE) * pf
    ELSE pd END AS zfraud_pr FROM parts
), ranked AS (
  SELECT *, CAST(row_number() OVER (
    PARTITION BY "day" ORDER BY zfraud_pr DESC, tx_id) AS INT) AS tx_rank FROM scored
)"""
)


def _vote_mean(model: int) -> str:
    votes = [
        f"CAST(tx_id * {37 + 20 * model + 2 * t} % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE)"
        for t in range(10)
    ]
    return f"({' + '.join(votes)}) / CAST(10 AS DOUBLE)"


_INT_FEATURES = {"boo1", "boo2"}
_VECTOR = ", ".join(
    f"CAST({'CAST(' + c + ' AS INT)' if c in _INT_FEATURES else c} AS DOUBLE) AS {c}"
    for c in FEATURES
)

_TRAIN_DAYS = "days AS (SELECT DISTINCT CAST(floor(tx_dhour / 24) AS INT) AS d FROM tx)"

# The riskiest rows of the four days before the last one, by amount and risk of the category.
_RISKIEST = """, last AS (SELECT max(tx_dhour) // 24 AS d FROM enc), riskiest AS (
  SELECT d, label FROM (
    SELECT tx_dhour // 24 AS td, label, row_number() OVER (
      PARTITION BY tx_dhour // 24 ORDER BY tx_amount * cat1 DESC, tx_id) AS place FROM enc
  ) JOIN last ON td BETWEEN d - 4 AND d - 1 WHERE place <= 20
)"""


def _bags(source: str) -> str:
    """The balanced bags of the rows of ``source``, as ``bagged``."""
    return f""", n AS (
  SELECT count(*) FILTER (NOT label) AS n0, count(*) FILTER (label) AS n1 FROM {source}
), plan AS (
  SELECT CAST(greatest(2, coalesce(n0 // nullif(n1, 0), 0)) AS INT) AS n_groups FROM n WHERE n0 > 10
), drawn AS (
  SELECT tx_id, label, 0 AS shard, n_groups,
    CAST(CAST('0x' || substr(md5(CAST(tx_id AS VARCHAR)), 1, 7) AS BIGINT) % n_groups AS INT) AS bag
  FROM {source}, plan WHERE NOT label
), bagged AS (
  SELECT tx_id, label, shard, bag FROM drawn WHERE bag < least(10, n_groups)
  UNION ALL
  SELECT tx_id, label, 0, CAST(b AS INT) FROM {source}, plan, range(0, 10) r(b)
  WHERE label AND b < least(10, n_groups)
)"""


# Rows as the engine reads them from their lines; hours count from the first good line.
_STREAMED = (
    _ENCODED
    + f""", good AS (
  SELECT * REPLACE (
    CASE WHEN tx_id % 83 = 0 THEN CAST(88 AS DOUBLE) ELSE tx_amount END AS tx_amount,
    tx_id % 73 = 0 OR boo1 AS boo1,
    CASE WHEN tx_id % 71 = 0 THEN 0.002809 ELSE merchant END AS merchant,
    CAST((tx_ms - (SELECT min(tx_ms) FROM tx WHERE {_GOOD})) // 3600000 AS INT) AS tx_dhour
  ), tx_dhour // 120 AS batch_id FROM enc WHERE {_GOOD}
), clocks AS (
  SELECT batch_id, min(tx_dhour) AS clock_hour, count(*) AS n_good FROM good GROUP BY batch_id
), stored AS (
  SELECT * FROM good QUALIFY row_number() OVER (
    PARTITION BY cardid, tx_dhour, tx_datetime ORDER BY tx_id DESC) = 1
)"""
)

ORACLE: dict[str, str] = {
    "parse_tx": _TX
    + f"""
SELECT tx_id, tx_ms AS tx_datetime, cardid,
  CASE WHEN tx_id % 83 = 0 THEN 88.0 ELSE tx_amount END AS tx_amount,
  CASE WHEN tx_id % 73 = 0 THEN true ELSE boo1 END AS boo1, boo2,
  CASE WHEN tx_id % 79 = 0 THEN 42 ELSE age END AS age, label, cat1_level, cat2_level,
  CASE WHEN tx_id % 71 = 0 THEN 'zzz' ELSE merchant_level END AS merchant_level,
  merchantarea_level, 'n' || nationality AS nationality_level, 'g' || gender AS gender_level,
  't' || cat3 AS cat3_level, 'u' || cat4 AS cat4_level
FROM tx WHERE {_GOOD}""",
    "parse_rejects": _TX
    + f"""
SELECT tx_id, CASE WHEN tx_id % 97 = 0 THEN 'arity' ELSE 'datetime' END AS reject_reason
FROM tx WHERE NOT ({_GOOD})""",
    "time_fields": _TX + f" SELECT tx_id, tx_dhour, tx_hour, tx_dayw FROM tx WHERE {_GOOD}",
    "dict_load": _DICT + " SELECT variable, level, id, CAST(risk AS DOUBLE) AS risk FROM dictionary",
    "encode_risk": _ENCODED
    + f"""
SELECT tx_id, cat1, cat2, CASE WHEN tx_id % 71 = 0 THEN 0.002809 ELSE merchant END AS merchant,
  merchantarea FROM enc WHERE {_GOOD}""",
    "encode_id": _TX + f" SELECT tx_id, nationality, gender, cat3, cat4 FROM tx WHERE {_GOOD}",
    "history_scan": _ENCODED
    + """
SELECT tx_id, cardid, tx_dhour, tx_ms AS tx_datetime, tx_amount, boo1, merchantarea, cat1, cat2,
  merchant FROM enc""",
    "dedupe_key": _TX
    + """, written AS (
  SELECT tx_id, cardid, tx_dhour, tx_ms, tx_amount, CAST(tx_dhour AS BIGINT) AS batch_id FROM tx
  UNION ALL SELECT tx_id, cardid, tx_dhour, tx_ms, tx_amount + 1, tx_dhour + 1
    FROM tx WHERE tx_id % 10 = 0
)
SELECT tx_dhour, tx_ms AS tx_datetime, cardid, tx_id, tx_amount, batch_id FROM written
QUALIFY row_number() OVER (
  PARTITION BY tx_dhour, tx_ms, cardid ORDER BY batch_id DESC, tx_id DESC) = 1""",
    "batch_cards": _TX
    + """
SELECT CAST(tx_dhour // 24 AS BIGINT) AS batch_seq, cardid, count(*) AS batch_rows
FROM tx GROUP BY 1, 2""",
    "history_semi": _TX
    + """, cards AS (SELECT DISTINCT tx_dhour // 24 AS batch_seq, cardid FROM tx)
SELECT CAST(c.batch_seq AS BIGINT) AS batch_seq, tx.cardid, tx.tx_id, tx.tx_dhour
FROM tx JOIN cards c ON c.cardid = tx.cardid AND tx.tx_dhour // 24 < c.batch_seq
  AND tx.tx_dhour > c.batch_seq * 24 - 120""",
    "amount_stats": _DAILY
    + f"""
SELECT DISTINCT CAST(batch_seq AS BIGINT) AS batch_seq, cardid, {', '.join(AMOUNT_STATS)}
FROM feats""",
    "area_stats": _DAILY
    + f"""
SELECT DISTINCT CAST(batch_seq AS BIGINT) AS batch_seq, cardid, {', '.join(AREA_STATS)}
FROM feats""",
    "last_tx": _DAILY
    + f"""
SELECT DISTINCT CAST(batch_seq AS BIGINT) AS batch_seq, cardid, {', '.join(LAST_TX)} FROM feats""",
    "asof_features": _HOURLY + f" SELECT tx_id, {_FEATS} FROM feats",
    "asof_features_6h": _batches(6) + f" SELECT tx_id, {_FEATS} FROM feats",
    "card_features": _HOURLY
    + f"""
SELECT tx_id, cardid, cat1, cat2, merchant, merchantarea, tx_amount, tx_ms AS tx_datetime, tx_dhour,
  tx_hour, tx_dayw, boo1, boo2, age, nationality, gender, cat3, cat4, label, {_FEATS}
FROM enc JOIN feats USING (tx_id)""",
    "batch_clock": _TX
    + """, firsts AS (
  SELECT CAST(tx_dhour AS BIGINT) AS batch_seq, count(*) AS n_rows, min(tx_ms) AS first_ms
  FROM tx GROUP BY 1
), running AS (
  SELECT *, max(first_ms) OVER (ORDER BY batch_seq) AS clock_ms,
    (SELECT min(tx_ms) FROM tx) AS origin FROM firsts
)
SELECT batch_seq, n_rows, first_ms, clock_ms,
  CAST((clock_ms - origin) // 3600000 AS INT) AS clock_hour,
  CAST((clock_ms - origin) // 86400000 AS INT) AS clock_day FROM running""",
    "retention": _TX
    + """
SELECT tx_dhour + 120 AS clock_hour, tx_dhour AS removed_hour, count(*) AS n_rows FROM tx
WHERE tx_dhour + 120 <= (SELECT max(tx_dhour) FROM tx) GROUP BY tx_dhour""",
    "retained_rows": _TX
    + """
SELECT tx_id, tx_dhour FROM tx WHERE tx_dhour > (SELECT max(tx_dhour) FROM tx) - 120""",
    "late_rows": _TX
    + _LATE.format(source="tx")
    + """
SELECT tx_id, batch_seq, tx_dhour, clock_hour, tx_dhour < clock_hour AS is_late,
  tx_dhour <= clock_hour - 120 AS is_expired
FROM arr JOIN clocks USING (batch_seq)""",
    "late_asof": _ENCODED
    + _LATE.format(source="enc")
    # A key written again by a later batch counts in its new version from then on.
    + """, versions AS (
  SELECT * FROM arr QUALIFY row_number() OVER (
    PARTITION BY cardid, tx_dhour, tx_datetime, batch_seq ORDER BY tx_id DESC) = 1
), stored AS (
  SELECT *, lead(batch_seq) OVER (
    PARTITION BY cardid, tx_dhour, tx_datetime ORDER BY batch_seq) AS until FROM versions
), feats AS ("""
    + _stats(
        "FROM arr b JOIN clocks c ON c.batch_seq = b.batch_seq "
        "LEFT JOIN stored h ON h.cardid = b.cardid AND h.batch_seq < b.batch_seq "
        "AND (h.until IS NULL OR b.batch_seq <= h.until) AND h.tx_dhour > c.clock_hour - 120",
        "b.tx_id, b.batch_seq",
    )
    + f") SELECT tx_id, batch_seq, {_FEATS} FROM feats",
    "batch_metrics": _TX
    + f"""
SELECT tx_dhour AS batch_id, CAST(floor(tx_dhour / 24) AS INT) AS day_no, count(*) AS n_in,
  count(*) FILTER (NOT ({_GOOD})) AS n_dropped, count(*) FILTER ({_GOOD}) AS n_good
FROM tx GROUP BY tx_dhour""",
    "train_window_recent": _TX
    + """
SELECT tx_id, tx_dhour, label, 4 AS train_day FROM tx
WHERE tx_dhour > 72 AND tx_dhour < 96 AND (SELECT max(tx_dhour) FROM tx) >= 96""",
    "train_window_delayed": _TX
    + f""", {_TRAIN_DAYS}
SELECT tx_id, tx_dhour, label, d AS train_day FROM tx JOIN days
  ON d > 7 AND tx_dhour < 24 * (d - 2) AND tx_dhour > 24 * d - 120""",
    "train_bags": _TX + _bags("tx") + " SELECT * FROM bagged",
    "train_delayed": _TX
    + """, last AS (SELECT CAST(max(tx_dhour) // 24 AS INT) AS d FROM tx), win AS (
  SELECT tx.* FROM tx, last WHERE d > 7 AND tx_dhour < 24 * (d - 2) AND tx_dhour > 24 * d - 120
)"""
    + _bags("win")
    + """
SELECT shard, bag, bag + 1 AS seed, count(*) FILTER (NOT label) AS n_genuine,
  count(*) FILTER (label) AS n_fraud FROM bagged GROUP BY shard, bag""",
    "score_delayed": _TX + " SELECT tx_id, true AS in_unit FROM tx",
    "train_feedback": _ENCODED
    + _RISKIEST
    + """
SELECT CAST(d AS INT) AS "day", count(*) AS n_rows, count(*) FILTER (label) AS n_fraud,
  100 AS n_trees FROM riskiest GROUP BY d""",
    "score_feedback": _ENCODED
    + _RISKIEST
    + """
SELECT tx_id, (SELECT count(*) FROM riskiest) > 0 AS in_unit,
  (SELECT count(*) FROM riskiest) = 0 AS no_forest FROM enc""",
    # Half-day batches; the clock is the first good time so far, counted from the first good line.
    "stream_replay": _TX
    + f""", parts AS (
  SELECT tx_dhour // 12 AS batch_id, count(*) AS n_in, count(*) FILTER ({_GOOD}) AS n_good,
    min(tx_ms) FILTER ({_GOOD}) AS first_ms FROM tx GROUP BY 1
), clocked AS (
  SELECT *, CAST((max(first_ms) OVER (ORDER BY batch_id) - first_value(first_ms) OVER (ORDER BY batch_id))
    // 86400000 AS INT) AS "day" FROM parts
)
SELECT CAST(batch_id AS BIGINT) AS batch_id, "day", n_in, n_in - n_good AS n_dropped,
  CASE WHEN "day" > 3 THEN CAST(least(20, sum(n_good) OVER (PARTITION BY "day" ORDER BY batch_id)) AS BIGINT)
    ELSE 0 END AS n_alerts
FROM clocked""",
    "stream_history": _STREAMED
    + ", feats AS ("
    + _stats(
        "FROM good b JOIN clocks c ON c.batch_id = b.batch_id LEFT JOIN stored h ON h.cardid = b.cardid "
        "AND h.batch_id < c.batch_id AND h.tx_dhour > c.clock_hour - 120",
        "b.tx_id",
    )
    + f""")
SELECT tx_id, CAST(batch_id AS BIGINT) AS batch_id, cardid, tx_ms AS tx_datetime, tx_dhour, tx_amount, boo1, label,
  cat1, cat2, merchant, merchantarea, {_FEATS}
FROM good JOIN feats USING (tx_id)
WHERE tx_dhour > (SELECT max(clock_hour) FROM clocks) - 120""",
    # A batch's list is closed by the next batch of a later day; there are lists once a model is live.
    "stream_alerts": _STREAMED
    + """, days AS (
  SELECT clock_hour // 24 AS d, lag(clock_hour // 24) OVER (ORDER BY batch_id) AS before,
    lag(n_good) OVER (ORDER BY batch_id) AS n_good FROM clocks
)
SELECT CAST(d - 1 AS INT) AS "day", CAST(place AS INT) AS tx_rank, true AS falling
FROM days, range(1, 21) r(place) WHERE before > 3 AND d > before AND place <= n_good""",
    "stream_rejects": _TX
    + f"""
SELECT tx_id, CAST(tx_dhour // 120 AS BIGINT) AS batch_id,
  CASE WHEN tx_id % 97 = 0 THEN 'arity' ELSE 'datetime' END AS reject_reason
FROM tx WHERE NOT ({_GOOD})""",
    "model_schedule": _TX
    + f""", {_TRAIN_DAYS}
SELECT d AS day_no, d > 3 AND d < 5 AS train_recent, d > 7 AS train_delayed, d > 4 AS close_alerts,
  d > 8 AS drop_alert_day, d > 7 AS train_feedback FROM days""",
    "feature_vector": _HOURLY
    + f"""
SELECT tx_id, {_VECTOR}, CAST(CAST(label AS INT) AS DOUBLE) AS "class"
FROM enc JOIN feats USING (tx_id)""",
    "score_default": _TX
    + """
SELECT tx_id, cardid, CAST(0.1 AS DOUBLE) AS zfraud_pr, CAST(0.1 AS DOUBLE) AS zfraud_pr_d,
  CAST(0.1 AS DOUBLE) AS zfraud_pr_f FROM tx""",
    "vote_average": _TX
    + f""", means AS (SELECT tx_id, {_vote_mean(0)} AS pd_0, {_vote_mean(1)} AS pd_1 FROM tx)
SELECT tx_id, pd_0, pd_1, (pd_0 + pd_1) / CAST(2 AS DOUBLE) AS pd FROM means""",
    "ensemble_score": _SCORED + " SELECT tx_id, pd, pf, zfraud_pr FROM scored",
    "batch_top100": _SCORED
    + """
SELECT "day", tx_rank AS place, tx_id, zfraud_pr FROM ranked WHERE tx_rank <= 100""",
    "daily_alerts": _SCORED
    + """
SELECT tx_rank, tx_id, cardid, "day", tx_datetime, label, tx_amount, zfraud_pr, pd, pf
FROM ranked WHERE tx_rank <= 20""",
    "feedback_window": _SCORED
    + """, days AS (SELECT DISTINCT "day" AS d FROM scored)
SELECT d AS train_day, "day", tx_rank, tx_id, label FROM ranked JOIN days
  ON d > 7 AND "day" BETWEEN d - 4 AND d - 1 WHERE tx_rank <= 20""",
}
