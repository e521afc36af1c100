"""Line parsing, field by field."""

import pytest

from cardwarden.config import EngineConfig
from cardwarden.functions import text
from cardwarden.functions.clock import with_time_fields
from cardwarden.operators.parse import accepted, parse_lines, rejects
from pyspark.sql import functions as F

CFG = EngineConfig()
GOOD = dict(
    cardid='"46 "', cat1="click", cat2="c1", merchant="m9", merchantarea='"a,8"', tx_amount="12.5",
    tx_datetime='"2024-01-07 13:45:10"', boo1='"false"', boo2="TRUE", age='"33"', nationality="n4",
    gender="g1", cat3="t2", cat4="u5", label="true",
)

# A plain look-ahead pattern, as the expectation.
COMMA_OUTSIDE_QUOTES = r',(?=([^"]*"[^"]*")*[^"]*$)'


def line(**changes):
    return ",".join({**GOOD, **changes}.values())


def parse(spark, *lines):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "tx_id long, value string")
    return parse_lines(df.repartition(3), CFG)


def one(spark, **changes):
    rows = accepted(parse(spark, line(**changes))).collect()
    return rows[0] if rows else None


def test_good_line(spark):
    row = one(spark)
    assert (row.cardid, row.merchantarea_level, row.tx_amount) == ("46", "a,8", 12.5)
    assert (row.boo1, row.boo2, row.age, row.label) == (False, True, 33, True)
    assert str(row.tx_datetime) == "2024-01-07 13:45:10"


@pytest.mark.parametrize(
    "value, want",
    [("abc", 88.0), ("", 88.0), ('"12"', 88.0), ("1e3", 1000.0), (" 7 ", 7.0), ("inf", 88.0),
     ("nan", 88.0), ("Infinity", float("inf")), ("-4.5", -4.5)],
)
def test_amount(spark, value, want):
    assert one(spark, tx_amount=value).tx_amount == want


@pytest.mark.parametrize(
    "value, want",
    [("4x", 42), (" 12 ", 42), ("+7", 7), ("-3", -3), ("3000000000", 42), ("", 42), ("1.0", 42)],
)
def test_age(spark, value, want):
    assert one(spark, age=value).age == want


@pytest.mark.parametrize(
    "value, boo, label",
    [("true", True, True), ("FALSE", False, False), ("1", True, False), ("yes", True, False),
     ("0", True, False), ("", True, False), ('"true"', True, False), (" true", True, False)],
)
def test_booleans(spark, value, boo, label):
    row = one(spark, boo1=value, label=value)
    assert (row.boo1, row.label) == (boo, label)


def test_quoted_false_label_and_flag(spark):
    row = one(spark, boo1='"false"', label='"false"')
    assert (row.boo1, row.label) == (False, False)


@pytest.mark.parametrize(
    "bad, reason",
    [(line() + ",x", "arity"), (line().rsplit(",", 1)[0], "arity"), ("", "arity"),
     (line(tx_datetime="bad"), "datetime"), (line(tx_datetime="bad") + ",x", "arity"),
     (line(tx_datetime="2024-02-30 00:00:00"), "datetime")],
)
def test_rejects(spark, bad, reason):
    assert [r.reject_reason for r in rejects(parse(spark, bad)).collect()] == [reason]


@pytest.mark.parametrize(
    "value, want",
    [("2024-1-7 1:2:3", "2024-01-07 01:02:03"), ("2024-01-07 10:00:00.0", "2024-01-07 10:00:00"),
     ("2024-01-07 10:00:00 CET", "2024-01-07 10:00:00")],
)
def test_lenient_dates(spark, value, want):
    assert str(one(spark, tx_datetime=value).tx_datetime) == want


@pytest.mark.parametrize("value", ["2024-13-07 10:00:00", "2024-01-07 25:00:00", "2024-01-07"])
def test_dates_out_of_range_are_rejected(spark, value):
    assert one(spark, tx_datetime=value) is None


def test_null_line_is_rejected(spark):
    assert [r.reject_reason for r in rejects(parse(spark, None)).collect()] == ["arity"]


def test_split_agrees_with_the_pattern(spark):
    samples = [
        "", ",", 'a,b,', '"a,b",c', 'a"b,c"d,e', '"a,b', 'a,"b,c', '",",",",x', 'x,"","y,z",,',
        'a,￿,"b,c"', 'a￿1b,￿0,c', '￿,"￿,1"', '""",",a',
    ]
    df = spark.createDataFrame([(s,) for s in samples], "value string")
    rows = df.select(
        "value",
        text.split_quoted(F.col("value")).alias("got"),
        F.split("value", COMMA_OUTSIDE_QUOTES, -1).alias("want"),
    ).collect()
    assert all(r.got == r.want for r in rows), rows


def test_a_line_full_of_quotes_is_only_a_reject(spark):
    assert rejects(parse(spark, '"' * 200_000 + ",", line())).count() == 1


def test_card_id_loses_control_characters(spark):
    assert one(spark, cardid='"\t 7 a\u0001 "').cardid == "7 a"


def test_time_fields_truncate_toward_zero(spark):
    rows = accepted(parse(spark, line(tx_datetime="2024-01-07 12:30:00"), line()))
    origin = rows.agg(F.max(F.unix_millis("tx_datetime"))).first()[0]
    got = {r.tx_hour: (r.tx_dhour, r.tx_dayw) for r in with_time_fields(rows, origin).collect()}
    assert got == {12: (-1, 1), 13: (0, 1)}
