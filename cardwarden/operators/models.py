"""Delayed trees and the feedback forest, as distributed MLlib fits."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from weakref import WeakKeyDictionary

from pyspark import inheritable_thread_target
from pyspark.errors import IllegalArgumentException
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwarden.config import EngineConfig
from cardwarden.functions.scores import ensemble, mean_of
from cardwarden.operators.vectors import with_vector
from cardwarden.schema import FEATURES
from cardwarden.session import few_bytes, materialize, workers


@dataclass(frozen=True)
class TreeBag:
    """A delayed model: the trees of all bags as one forest. Their mean vote is the score.

    ``bags`` tells of each freshly trained tree its shard, bag, seed, genuine and fraud rows.
    """

    model_id: str
    trained_day: int
    forest: RandomForestClassificationModel
    bags: tuple[tuple[int, int, int, int, int], ...] = ()

    @property
    def trees(self) -> list:
        return self.forest.trees


def one_forest(spark: SparkSession, forests: list[RandomForestClassificationModel]) -> RandomForestClassificationModel:
    """The trees of several forests as one, so that rows are scored in one pass with one broadcast.

    A forest's vote is the mean of its trees' votes. Python has no constructor for it, so it is the
    JVM's that is called.
    """
    first = forests[0]
    found = [tree for forest in forests for tree in forest._java_obj.trees()]
    kinds = spark._jvm.org.apache.spark.ml.classification
    array = spark.sparkContext._gateway.new_array(kinds.DecisionTreeClassificationModel, len(found))
    for i, tree in enumerate(found):
        array[i] = tree
    whole = kinds.RandomForestClassificationModel(first.uid, array, first.numFeatures, first.numClasses)
    for name, value in (("numTrees", len(found)), ("featuresCol", first.getFeaturesCol())):
        whole.set(whole.getParam(name), value)
    return RandomForestClassificationModel._from_java(whole)


def _classifier(trees: int, seed: int, bootstrap: bool, cfg: EngineConfig, copies: int):
    return RandomForestClassifier(
        labelCol="class",
        numTrees=trees,
        bootstrap=bootstrap,
        # A bootstrap takes each row Poisson(1) times; ``copies`` draws of 1/copies add up to that.
        subsamplingRate=1.0 / copies if bootstrap else 1.0,
        featureSubsetStrategy="log2",
        minInstancesPerNode=1,
        maxDepth=cfg.tree_depth,
        maxBins=cfg.max_bins,
        seed=seed,
        cacheNodeIds=False,
    )


def _fitted(
    rows: DataFrame, n_rows: int, trees: int, seed: int, bootstrap: bool, cfg: EngineConfig
) -> RandomForestClassificationModel | None:
    """The forest fitted on the ``n_rows`` vectors of ``rows``, or None where MLlib refuses the rows
    themselves; the stream goes on with the other trees. Anything else, such as a lost executor,
    is raised.

    MLlib wants at least as many rows as a nominal feature has values, so a smaller set repeats
    every row equally often. That leaves all split gains the same, and the draws of a bootstrap
    are thinned by as much, so a row's total draws keep their distribution.
    """
    rows = rows.select("features", "class")
    copies = -(-max(cfg.arity.values()) // n_rows)
    if copies > 1:
        again = F.explode(F.sequence(F.lit(1), F.lit(copies)))
        rows = rows.withColumn("_copy", again).select("features", "class")
    try:
        return _classifier(trees, seed, bootstrap, cfg, copies).fit(rows)
    except IllegalArgumentException as fault:
        logging.getLogger(__name__).warning("a tree was skipped: %s", fault)
        return None


def train_delayed(bagged: DataFrame, cfg: EngineConfig, model_id: str, day: int) -> TreeBag | None:
    """One random tree per bag of ``bagged`` (columns ``shard`` and ``bag``); None without rows.

    The bags are written once as vectors, one folder per bag, so each fit scans only its own rows. The
    driver holds the list of bags (``n_shards * n_tree`` at most), never their rows.
    """
    needed = bagged.select("shard", "bag", "label", *FEATURES)
    needed = with_vector(needed, label=True, arity=cfg.arity).select("shard", "bag", "label", "features", "class")
    bags = materialize(
        needed.hint("rebalance", "shard", "bag"), "bags", partition_by=("shard", "bag")
    )
    counted = bags.coalesce(1) if few_bytes(bags) else bags
    sizes = counted.groupBy("shard", "bag").agg(
        F.count("*").alias("n_rows"), F.count_if("label").alias("n_fraud")
    )
    found = sizes.orderBy("shard", "bag").collect()

    def fit(row) -> RandomForestClassificationModel | None:
        rows = bags.where((F.col("shard") == row["shard"]) & (F.col("bag") == row["bag"]))
        return _fitted(rows, row["n_rows"], 1, row["bag"] + 1, False, cfg)

    if not found:
        return None
    trees = list(workers(cfg.fit_parallelism).map(inheritable_thread_target(bagged.sparkSession)(fit), found))
    grown = [(t, r) for t, r in zip(trees, found) if t is not None]
    facts = [
        (r["shard"], r["bag"], r["bag"] + 1, r["n_rows"] - r["n_fraud"], r["n_fraud"]) for _, r in grown
    ]
    if not grown:
        return None
    return TreeBag(model_id, day, one_forest(bagged.sparkSession, [t for t, _ in grown]), tuple(facts))


def train_feedback(alerts: DataFrame, cfg: EngineConfig) -> RandomForestClassificationModel | None:
    """A forest on the alerts of the feedback days with their true labels; None without alerts."""
    n_rows = alerts.count()
    if n_rows == 0:
        return None
    return _fitted(with_vector(alerts, label=True, arity=cfg.arity), n_rows, cfg.feedback_trees, 1, True, cfg)


# Per model its copies that put out one column; a copy shares the trees.
_QUIET: WeakKeyDictionary = WeakKeyDictionary()


def _with_vote(df: DataFrame, model: RandomForestClassificationModel, name: str) -> DataFrame:
    """Add P(fraud) as a vector column; the other outputs of the model are switched off."""
    copies = _QUIET.setdefault(model, {})
    if name not in copies:
        copies[name] = model.copy({model.rawPredictionCol: "", model.predictionCol: "", model.probabilityCol: name})
    return copies[name].transform(df)


def _fraud(name: str) -> Column:
    return vector_to_array(F.col(name))[1]


def score_delayed(df: DataFrame, models: list[TreeBag], out: str = "zfraud_pr_d") -> DataFrame:
    """Mean over live models of the mean tree vote; needs ``features``."""
    votes = [f"_v{m}" for m in range(len(models))]
    for name, model in zip(votes, models):
        df = _with_vote(df, model.forest, name)
    return df.withColumn(out, mean_of([_fraud(n) for n in votes])).drop(*votes)


def score_feedback(
    df: DataFrame, forest: RandomForestClassificationModel | None, out: str = "zfraud_pr_f"
) -> DataFrame:
    """P(fraud) of the forest, or -1 while there is none; needs ``features``."""
    if forest is None:
        return df.withColumn(out, F.lit(-1.0))
    return _with_vote(df, forest, "_vf").withColumn(out, _fraud("_vf")).drop("_vf")


def node_table(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of a saved forest: tree, node, left and right (-1 in leaves), the feature's slot,
    the threshold of a number or the codes that go left, and P(fraud) of the node's training rows.
    """
    node, split = F.col("nodeData"), F.col("nodeData.split")
    stats, values = node["impurityStats"], split["leftCategoriesOrThreshold"]
    nominal = split["numCategories"] >= 0
    return spark.read.parquet(f"{folder}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("node"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        split["featureIndex"].alias("feature"),
        F.when(~nominal, F.get(values, F.lit(0))).alias("threshold"),
        F.when(nominal, values).alias("left_codes"),
        F.coalesce(F.try_divide(stats[1], stats[0] + stats[1]), F.lit(0.0)).alias("fraud"),
    )


def unscored(df: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The three scores of rows that arrive before the first model."""
    return df.withColumns(
        {c: F.lit(cfg.unscored) for c in ("zfraud_pr", "zfraud_pr_d", "zfraud_pr_f")}
    )


def score(
    df: DataFrame,
    models: list[TreeBag],
    forest: RandomForestClassificationModel | None,
    cfg: EngineConfig,
) -> DataFrame:
    """Add the ensemble score and its two parts."""
    if not models:
        return unscored(df, cfg)
    parts = score_feedback(score_delayed(with_vector(df, arity=cfg.arity), models), forest)
    total = ensemble(F.col("zfraud_pr_d"), F.col("zfraud_pr_f"))
    return parts.withColumn("zfraud_pr", total).drop("features")
