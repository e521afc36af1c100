"""Training and scoring."""

import pytest
from pyspark.sql import functions as F

from cardwarden.config import EngineConfig
from cardwarden.operators.bags import balanced_bags
from cardwarden.operators.models import (
    node_table,
    one_forest,
    score,
    score_delayed,
    score_feedback,
    train_delayed as fit_bags,
    train_feedback,
)
from cardwarden.operators.vectors import with_vector
from cardwarden.schema import FEATURES, NOMINAL_ARITY

CFG = EngineConfig(n_tree=3, feedback_trees=10, tree_depth=8, fit_parallelism=3)


def train_delayed(train, cfg, model_id, day):
    return fit_bags(balanced_bags(train, cfg), cfg, model_id, day)


def rows(spark, genuine, fraud):
    """Frauds have high amounts; every other feature is noise."""
    df = spark.range(genuine + fraud).select(
        F.col("id").alias("tx_id"), (F.col("id") < fraud).alias("label")
    )
    noise = {
        c: F.pmod(F.xxhash64("tx_id", F.lit(c)), F.lit(NOMINAL_ARITY.get(c, 1000))).cast("double")
        for c in FEATURES
    }
    noise["boo1"], noise["boo2"] = F.col("tx_id") % 2 == 0, F.col("tx_id") % 3 == 0
    noise["tx_amount"] = F.when(F.col("label"), 5000.0).otherwise(10.0) + noise["age"] / 100
    for c in ("w1_max_amount", "w1_sum_amount", "merchant", "cat1", "last_cat1", "tx_hour"):
        noise[c] = noise["tx_amount"]
    return df.withColumns(noise)


@pytest.fixture(scope="module")
def data(spark):
    return rows(spark, 400, 40).persist()


def test_planted_frauds_rank_first(spark, data):
    bag = train_delayed(data, CFG, "delayed-8-0", 8)
    assert len(bag.trees) == 3
    scored = score_delayed(with_vector(data), [bag]).collect()
    assert all(0 <= r.zfraud_pr_d <= 1 for r in scored)
    best = sorted(scored, key=lambda r: -r.zfraud_pr_d)[:40]
    assert sum(r.label for r in best) >= 38


def test_same_rows_same_trees_on_any_layout(spark, data):
    got = []
    for parts in (1, 5):
        bag = train_delayed(data.repartition(parts), CFG, "m-8-0", 8)
        got.append([t.toDebugString.split("\n", 1)[1] for t in bag.trees])
    assert got[0] == got[1]


def test_bags_without_fraud_vote_zero(spark):
    bag = train_delayed(rows(spark, 60, 0), CFG, "m-8-0", 8)
    scored = score_delayed(with_vector(rows(spark, 5, 5)), [bag])
    assert scored.where("zfraud_pr_d <> 0").isEmpty()


def test_tiny_sets_train(spark):
    assert len(train_delayed(rows(spark, 12, 2), CFG, "m-8-0", 8).trees) == 3
    forest = train_feedback(rows(spark, 2, 3), CFG)
    assert score_feedback(with_vector(rows(spark, 3, 3)), forest).count() == 6


def test_no_rows_no_model(spark):
    empty = rows(spark, 0, 0)
    assert train_delayed(empty, CFG, "m-8-0", 8) is None
    assert train_feedback(empty, CFG) is None


def test_ensemble_of_two_models_and_feedback(spark, data):
    bags = [train_delayed(data.where(f"tx_id % 2 = {i} OR label"), CFG, f"m-{i}-0", i) for i in (0, 1)]
    forest = train_feedback(data.limit(80), CFG)
    with_both = score(data, bags, forest, CFG)
    bad = with_both.where("abs(zfraud_pr - (zfraud_pr_d + zfraud_pr_f) / 2) > 1e-12")
    assert bad.isEmpty()
    alone = score(data, bags[:1], None, CFG)
    assert alone.where("zfraud_pr_f <> -1 OR zfraud_pr <> zfraud_pr_d").isEmpty()
    none = score(data, [], None, CFG)
    assert none.where("zfraud_pr = 0.1 AND zfraud_pr_d = 0.1 AND zfraud_pr_f = 0.1").count() == 440


def test_codes_outside_the_domain_become_zero(spark, data):
    odd = data.limit(1).withColumn("nationality", F.lit(77)).withColumn("gender", F.lit(-1))
    vector = with_vector(odd).first()["features"].toArray()
    assert vector[FEATURES.index("nationality")] == 0 and vector[FEATURES.index("gender")] == 0


def test_schema_of_the_vector(spark, data):
    attrs = with_vector(data).schema["features"].metadata["ml_attr"]["attrs"]
    assert sorted(a["idx"] for a in attrs["nominal"]) == sorted(FEATURES.index(c) for c in NOMINAL_ARITY)
    assert len(attrs["nominal"]) + len(attrs["numeric"]) == 31


def test_features_that_are_not_finite_enter_bounded(spark):
    from cardwarden.schema import LARGEST_FEATURE, feature_column

    values = [float("inf"), float("-inf"), float("nan"), 1e300, 2.5, None]
    df = spark.createDataFrame([(v,) for v in values], "tx_amount double")
    got = [r[0] for r in df.select(feature_column("tx_amount", "x")).collect()]
    assert got == [LARGEST_FEATURE, -LARGEST_FEATURE, 0.0, LARGEST_FEATURE, 2.5, None]


def test_small_sets_keep_the_draws_of_a_bootstrap(spark):
    """Trees on 4 rows weigh what a bootstrap of 4 weighs, though MLlib is given 20 rows."""
    cfg = EngineConfig(feedback_trees=200, tree_depth=8)
    forest = train_feedback(rows(spark, 2, 2), cfg)
    copies = max(NOMINAL_ARITY.values()) // 4
    weights = [t._java_obj.rootNode().impurityStats().count() for t in forest.trees]
    mean = sum(weights) / len(weights)
    spread = sum((w - mean) ** 2 for w in weights) / len(weights)
    assert copies == 5 and abs(mean - 4) < 0.5 and 2.5 < spread < 6


def test_codes_of_a_wider_dictionary_stay_apart(spark, data):
    wide = {**NOMINAL_ARITY, "nationality": 80}
    odd = data.limit(1).withColumn("nationality", F.lit(77))
    vector = with_vector(odd, arity=wide).first()["features"].toArray()
    assert vector[FEATURES.index("nationality")] == 77
    with pytest.raises(ValueError):
        EngineConfig(arity=wide)
    cfg = EngineConfig(arity=wide, max_bins=80, n_tree=2, tree_depth=4)
    assert len(train_delayed(data, cfg, "m-8-0", 8).trees) == 2


def test_node_table_walked_by_sql_gives_the_scores(spark, data, tmp_path):
    """The saved nodes, walked by a recursive query, vote as MLlib does."""
    import duckdb
    from pyspark.ml.functions import vector_to_array

    cfg = EngineConfig(n_tree=3, tree_depth=8)
    # Labels that follow codes as well as a number, so that both kinds of splits are walked.
    coded = data.withColumn("label", F.col("cat3").isin(1, 4, 6) & (F.col("age") > 300))
    bag = train_delayed(coded, cfg, "m-8-0", 8)
    bag.forest.write().save(f"{tmp_path}/m")
    scored = score_delayed(with_vector(coded), [bag]).select("tx_id", vector_to_array("features").alias("x"), "zfraud_pr_d")
    x, nodes = scored.toPandas(), node_table(spark, f"{tmp_path}/m").toPandas()
    con = duckdb.connect()
    con.register("x", x.assign(x=[list(v) for v in x.x])), con.register("nodes", nodes)
    walked = con.execute("""
      WITH RECURSIVE w AS (
        SELECT tx_id, x, tree, 0 AS node FROM x, (SELECT DISTINCT tree FROM nodes)
        UNION ALL
        SELECT w.tx_id, w.x, w.tree, CASE WHEN coalesce(x[n.feature + 1] <= n.threshold, list_contains(n.left_codes, x[n.feature + 1]))
          THEN n."left" ELSE n."right" END
        FROM w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE n."left" >= 0
      ) SELECT w.tx_id, avg(n.fraud) FROM w JOIN nodes n ON n.tree = w.tree AND n.node = w.node AND n."left" < 0 GROUP BY w.tx_id
    """).fetchall()
    want = dict(zip(x.tx_id, x.zfraud_pr_d))
    assert len(walked) == len(want) and max(abs(v - want[k]) for k, v in walked) < 1e-12
    assert nodes.left_codes.notna().any() and nodes.threshold.notna().any()


def test_one_forest_votes_as_its_trees(spark, data):
    from pyspark.ml.functions import vector_to_array

    parts = [train_delayed(data.where(f"tx_id % 2 = {i} OR label"), CFG, f"m-{i}-0", i).forest for i in (0, 1)]
    whole = one_forest(spark, parts)
    rows = with_vector(data)
    for i, forest in enumerate([*parts, whole]):
        named = forest.copy({forest.rawPredictionCol: "", forest.predictionCol: "", forest.probabilityCol: f"p{i}"})
        rows = named.transform(rows)
    p = [vector_to_array(F.col(f"p{i}"))[1] for i in range(3)]
    worst = rows.select(F.max(F.abs((p[0] + p[1]) / 2 - p[2]))).first()[0]
    assert whole.getNumTrees == 6 and worst < 1e-12
