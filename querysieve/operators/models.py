"""The six classifiers over ``expanded``.

Tree and naive Bayes are Spark ML's (the tree on information gain, pruned by its errors on a held-back third);
the forest (100 trees, depth 20, of each node the root of the columns) is ``forest``, boosted trees (second order, depth 6, 50 rounds, rate 0.1), boosted stumps (additive logistic regression, 50 rounds) and the
linear machine (dual, C = 1, columns scaled to 0..1) are ``boosting`` and ``dualmachine``.

Equal rows train as one row with a weight, so a log of any length is as large as its kinds of rows; also for the random
forest, which draws a kind as often as it would its rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier, NaiveBayes
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querysieve.operators import bayes, boosting, dualmachine, forest

SEED = 42
TREE_DEPTH = 12


def vectors(rows: DataFrame) -> DataFrame:
    """``features`` and ``label`` for Spark ML; a label other than 0 and 1 stops the job."""
    label = F.when(F.col("label").isin(0, 1), F.col("label").cast("double")).otherwise(F.raise_error(F.lit("labels are 0 or 1")).cast("double"))
    return rows.withColumns({"features": array_to_vector(F.col("expanded").cast("array<double>")), "label": label})


def weighted(rows: DataFrame) -> DataFrame:
    """Kinds of rows (``expanded`` and ``label``) with their number (or the sum of their ``weight``): one shuffle, combined before it."""
    number = F.sum("weight") if "weight" in rows.columns else F.count("*")
    kinds = rows.groupBy("expanded", "label").agg(number.cast("double").alias("weight"))
    return kinds.withColumn("features", array_to_vector(F.col("expanded").cast("array<double>")))


def random_forest(train: DataFrame, trees: int = 100, depth: int = 20):
    return forest.fit(weighted(train), trees, depth)


@dataclass(frozen=True)
class PrunedTree:
    """A fitted tree, and by its leaves (in order) what they say after pruning."""

    fitted: DecisionTreeClassificationModel
    classes: list[float]

    def transform(self, rows: DataFrame) -> DataFrame:
        said = self.fitted.setLeafCol("leaf").transform(rows)
        return said.withColumn("prediction", F.element_at(F.lit(self.classes), F.col("leaf").cast("int") + 1)).drop("leaf")


def tree(train: DataFrame):
    """Grown on two thirds of the kinds of rows (by hash); a branch stays only if it errs less on the rest than a leaf."""
    kinds = weighted(train).withColumn("held", F.pmod(F.xxhash64("expanded", "label", F.lit(SEED)), F.lit(3)) == 0).persist()
    try:
        grow = kinds.where("not held")
        fitted = DecisionTreeClassifier(impurity="entropy", maxDepth=TREE_DEPTH, seed=SEED, weightCol="weight").fit(grow if not grow.isEmpty() else kinds)
        at_leaf = fitted.setLeafCol("leaf").transform(kinds.where("held")).groupBy("leaf", "label").agg(F.sum("weight").alias("n"))
        return PrunedTree(fitted, pruned(fitted, {(int(r["leaf"]), int(r["label"])): r["n"] for r in at_leaf.collect()}))
    finally:
        kinds.unpersist()


def pruned(fitted: DecisionTreeClassificationModel, held: dict[tuple[int, int], float]) -> list[float]:
    """By leaf the class after reduced-error pruning; ``held`` counts held-back rows by leaf and label."""

    def visit(node, at: int) -> tuple[list[float], float, list[float], list[float]]:
        # classes of the leaves below, errors on held-back rows, and counts by class of those and of the others
        stats = list(node.impurityStats().stats()) + [0.0]
        if node.subtreeDepth() == 0:
            own = [held.get((at, k), 0.0) for k in (0, 1)]
            said = int(node.prediction())
            return [float(said)], own[1 - said], own, stats
        left = visit(node.leftChild(), at)
        right = visit(node.rightChild(), at + len(left[0]))
        classes, own = left[0] + right[0], [a + b for a, b in zip(left[2], right[2])]
        said = int(node.prediction())
        if own[1 - said] <= left[1] + right[1]:
            both = [a + b for a, b in zip(own, stats)]
            return [float(both[1] > both[0])] * len(classes), own[1 - said], own, stats
        return classes, left[1] + right[1], own, stats

    return visit(fitted._java_obj.rootNode(), 0)[0]


def boosted_trees(train: DataFrame, rounds: int = 50):
    return boosting.second_order_trees(weighted(train), rounds)


def boosted_stumps(train: DataFrame, rounds: int = 50):
    return boosting.logit_boost(weighted(train), rounds)


def linear_svm(train: DataFrame):
    return dualmachine.fit(weighted(train))


def naive_bayes(train: DataFrame):
    return NaiveBayes(modelType="gaussian", weightCol="weight").fit(weighted(train))


def precise_bayes(train: DataFrame):
    return bayes.fit(weighted(train))


MODELS: dict[str, Callable] = {
    "random_forest": random_forest,
    "tree": tree,
    "boosted_trees": boosted_trees,
    "boosted_stumps": boosted_stumps,
    "linear_svm": linear_svm,
    "naive_bayes": naive_bayes,
}
#: Models besides the six of the grid.
OTHERS: dict[str, Callable] = {"precise_bayes": precise_bayes}


def gaussian_parameters(rows: DataFrame, slots: list[str]) -> DataFrame:
    """label, slot, mean and variance (over n) of every slot: what the Gaussian model is made of."""
    long = rows.select("label", F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(s).cast("double").alias("x")) for s in slots])).alias("s")).select("label", "s.slot", "s.x")
    return long.groupBy("label", "slot").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))


def predictions(model, rows: DataFrame) -> DataFrame:
    """label, prediction, and the ``weight`` of rows that have one."""
    weight = [c for c in rows.columns if c == "weight"]
    return model.transform(rows).select(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"), *weight)
