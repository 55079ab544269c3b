"""Association rules from frequent itemsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querysieve.operators.held import held
from querysieve.operators.mining import itemsets


def association_rules(found: DataFrame, min_confidence: float) -> DataFrame:
    """``found`` (items ascending, freq) -> antecedent, consequent, support, confidence.

    Both sides are non-empty; confidence is the itemset's support over the antecedent's, which is frequent too and so in the
    same table.  Consequents grow item by item: moving an item from the antecedent to the consequent can only lower the
    confidence, so one that falls short isn't extended, and a longer one is tried only if it is two that hold joined.
    """
    found = held(found.select("items", "freq"))
    known = found.select(F.col("items").alias("antecedent"), F.col("freq").alias("antecedent_freq"))
    tried = found.where(F.size("items") > 1).select("items", "freq", F.explode("items").alias("item")).select("items", "freq", F.array("item").alias("consequent"))
    rules = None
    for _ in range(found.agg(F.coalesce(F.max(F.size("items")), F.lit(0))).first()[0] - 1):
        sides = tried.withColumn("antecedent", F.array_except("items", "consequent")).join(known, "antecedent")
        holding = held(sides.withColumn("confidence", F.col("freq") / F.col("antecedent_freq")).where(F.col("confidence") >= min_confidence))
        rules = holding if rules is None else rules.unionByName(holding)
        if holding.isEmpty():
            break
        ends = holding.select("items", "freq", F.expr("slice(consequent, 1, size(consequent) - 1)").alias("head"), F.element_at("consequent", -1).alias("tail"), "consequent")
        other = ends.select("items", "head", F.col("tail").alias("next"))
        joined = ends.join(other, ["items", "head"]).where("tail < next and size(consequent) + 1 < size(items)")
        tried = joined.select("items", "freq", F.array_append("consequent", F.col("next")).alias("consequent"))
    if rules is None:
        rules = tried.withColumns({"antecedent": F.col("items"), "confidence": F.lit(0.0)}).limit(0)
    return rules.select("antecedent", "consequent", F.col("freq").alias("support"), "confidence")


def mine_rules(transactions: DataFrame, min_support: float, min_confidence: float, miner=itemsets) -> DataFrame:
    return association_rules(miner(transactions, min_support), min_confidence)


def first_consequent(rules: DataFrame) -> DataFrame:
    """Rules as the feature expansion takes them: only the first item of the consequent; repeats stay."""
    return rules.select("antecedent", F.element_at("consequent", 1).alias("consequent"), "confidence")
