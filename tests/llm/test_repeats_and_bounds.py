"""Repeated rows, bounds on rows, and links that no turn of proposals finds."""

import random

from pyspark.sql import functions as F

from cardwarden.llm import linear, near_dedup, substring_dedup


def _texts(n, words, seed):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(5000)}" for _ in range(words)) for _ in range(n)]


def test_links_without_any_proposal(spark, monkeypatch):
    text = _texts(1, 200, 1)[0]
    docs = spark.createDataFrame([(1, text), (2, text + " tail"), (3, "other words here")], "doc_id long, text string")
    plain = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    proposals = near_dedup._Finder.proposals
    monkeypatch.setattr(near_dedup._Finder, "proposals", lambda self, live, turn: proposals(self, live, turn).where("false"))
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert found == plain == {1: 1, 2: 1, 3: 3}


def test_sample_bounds_rows_of_one_id(spark):
    rows = [(7, f"text {i}") for i in range(3000)] + [(i, f"own {i}") for i in range(20)]
    docs = spark.createDataFrame([(i, t.encode()) for i, t in rows], "doc_id long, text binary")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    few = linear.labelled_sample(docs, labels, F.lit(True), sample=100)
    assert few.count() == few.select("doc_id").distinct().count() == 20


def test_runs_grow_with_distinct_rows_only(spark):
    first, second = _texts(2, 120, 2)
    both = f"{first} {second}"
    rows = [(1, first)] + [(2, both)] * 400 + [(2, second)] * 50 + [(None, both)] * 3 + [(3, second)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_runs": F.lit(1), "_run_doc": F.lit(2)})
    joined, name = substring_dedup._with_runs(docs, "doc_id", "text", 50)
    size = joined.where("doc_id = 2").agg(F.max(F.size(name))).first()[0]
    assert size <= 12  # the runs of one copy, a few a bucket, not of all 400
    removed = substring_dedup.remove_repeats(docs).groupBy("doc_id", "n_words").agg(
        F.min("n_removed").alias("a"), F.max("n_removed").alias("b"), F.count("*").alias("n")
    )
    assert {tuple(r) for r in removed.collect()} == {
        (1, 120, 0, 0, 1), (2, 240, 120, 120, 400), (2, 120, 0, 0, 50), (None, 240, 0, 0, 3), (3, 120, 120, 120, 1),
    }
    cut = substring_dedup.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
