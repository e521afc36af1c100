"""Joins on hot keys give the rows of a plain join."""

from pyspark.sql import functions as F

from cardwarden.config import EngineConfig
from cardwarden.operators.encode import Dictionary, encode_risk
from cardwarden.operators.joins import fits_broadcast, hot_keys, spread_join


def sides(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("tx_id"),
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 50 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("k"), F.col("id") % 40))
        .alias("key"),
    )
    groups = rows.where("key IS NOT NULL AND key <> 'k7'").groupBy("key").agg(
        F.count("*").alias("n"), F.sum("tx_id").alias("total")
    )
    return rows, groups


def test_hot_key_join_equals_plain_join(spark):
    rows, groups = sides(spark)
    for limit, cap in ((100, 10), (20, 1000), (20, 3)):
        hot = hot_keys(groups, ["key"], "n", limit, cap)
        assert hot.count() <= cap
        for how in ("left", "inner"):
            got = spread_join(rows, groups, ["key"], "tx_id", hot, how)
            want = rows.join(groups, ["key"], how)
            cols = ["tx_id", "key", "n", "total"]
            assert got.select(cols).exceptAll(want.select(cols)).isEmpty()
            assert got.count() == want.count()


def test_hot_rows_are_dealt_to_many_tasks(spark):
    rows, groups = sides(spark)
    hot = hot_keys(groups, ["key"], "n", 100, 10)
    assert {r["key"]: r["_salts"] for r in hot.collect()} == {"hot": 10}


def test_no_hot_keys_no_salt(spark):
    rows, groups = sides(spark)
    assert hot_keys(groups, ["key"], "n", 10_000, 10) is None


def test_size_check(spark):
    assert fits_broadcast(spark.range(5), 5) and not fits_broadcast(spark.range(6), 5)


def test_large_dictionary_is_joined_without_broadcast(spark):
    """A dictionary over the limit takes the shuffled way, hot levels included."""
    levels = ["cat1_level", "cat2_level", "merchant_level", "merchantarea_level"]
    rows = spark.range(500).select(
        F.col("id").alias("tx_id"),
        *[F.when(F.col("id") % 3 == 0, "top").otherwise(F.concat(F.lit("l"), F.col("id") % 9)).alias(c)
          for c in levels],
    )
    entries = spark.createDataFrame(
        [(v, f"l{i}", 0, i / 10) for v in ("cat1", "merchant", "TERM_COUNTRY") for i in range(7)]
        + [("cat1", "top", 0, 0.9)],
        "variable string, level string, id int, risk double",
    )
    cfg = EngineConfig(broadcast_rows=5, hot_rows=50)
    big = Dictionary.of(entries, cfg)
    assert not big.small & {"cat1", "merchant", "TERM_COUNTRY"}
    got = encode_risk(rows, big, cfg)
    want = encode_risk(rows, Dictionary(entries), cfg).select(got.columns)
    assert got.exceptAll(want).isEmpty() and got.count() == 500


def test_history_of_many_cards_is_salted(spark):
    from cardwarden.operators.history import of_batch_cards

    rows, _ = sides(spark)
    history = rows.withColumnRenamed("key", "cardid")
    cards = history.where("cardid IN ('hot', 'k4', 'k5')").groupBy("cardid").agg(F.count("*").alias("n"))
    hot = hot_keys(cards, ["cardid"], "n", 100, 10)
    got = of_batch_cards(history, cards, False, hot)
    want = of_batch_cards(history, cards, True)
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() > 0


def test_one_long_list_leaves_the_other_lookups_broadcast(spark):
    from cardwarden.operators.encode import VARIABLES, encode_id

    entries = spark.createDataFrame(
        [("nationality", f"n{i}", i, 0.0) for i in range(30)] + [("GENDER", "g1", 1, 0.0)],
        "variable string, level string, id int, risk double",
    )
    cfg = EngineConfig(broadcast_rows=5)
    d = Dictionary.of(entries, cfg)
    assert d.small == VARIABLES - {"nationality"}
    wide = d.widened(cfg)
    assert wide.arity["nationality"] == 30 and wide.arity["gender"] == 3 and wide.max_bins == 32
    rows = spark.createDataFrame([(1, "n29", "g1", "t", "u"), (2, None, "g9", "t", "u")],
                                 "tx_id long, nationality_level string, gender_level string, "
                                 "cat3_level string, cat4_level string")
    got = {r.tx_id: (r.nationality, r.gender) for r in encode_id(rows, d, cfg).collect()}
    assert got == {1: (29, 1), 2: (0, 0)}


def test_card_rare_in_the_batch_and_hot_in_the_history(spark):
    from cardwarden.operators.history import batch_cards, of_batch_cards, stored_counts

    rows, _ = sides(spark)
    history = rows.withColumnRenamed("key", "cardid")
    cards = batch_cards(history.where("tx_id IN (0, 4, 5)"))
    assert cards.where("cardid = 'hot'").first()["batch_rows"] == 1
    hot = hot_keys(stored_counts(history, cards), ["cardid"], "stored_rows", 100, 10)
    assert {r["cardid"]: r["_salts"] for r in hot.collect()} == {"hot": 10}
    got, want = (of_batch_cards(history, cards, small, hot) for small in (False, True))
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() > 1000
