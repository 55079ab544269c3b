"""Naive Bayes whose spreads have a floor.

Each column has a precision, the mean gap between its distinct values: values are rounded to multiples of it, and no
deviation is below a sixth of it, so a column in which a class has one value only doesn't decide alone.  Shares of the
classes are smoothed by one row each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querysieve.operators.held import held

NO_GAP = 0.01  # precision of a column with one value


@dataclass(frozen=True)
class PreciseBayes:
    """By column the precision, and by class the log share and by column mean and deviation."""

    precision: list[float]
    classes: dict[float, tuple[float, list[float], list[float]]]

    def score(self, label: float) -> Column:
        share, means, deviations = self.classes[label]

        def term(x: Column, k: Column) -> Column:
            p, mean, deviation = (F.get(F.lit(v), k) for v in (self.precision, means, deviations))
            return -F.ln(deviation) - F.pow((F.rint(x / p) * p - mean) / deviation, F.lit(2)) / 2

        return F.aggregate(F.transform(F.col("expanded").cast("array<double>"), term), F.lit(share), lambda s, t: s + t)

    def transform(self, rows: DataFrame) -> DataFrame:
        if len(self.classes) < 2:
            return rows.withColumn("prediction", F.lit(next(iter(self.classes), 0.0)))
        return rows.withColumn("prediction", (self.score(1.0) > self.score(0.0)).cast("double"))


def fit(kinds: DataFrame) -> PreciseBayes:
    """``kinds``: expanded, label (0 or 1), weight.  Two aggregates; a row per column, and one per column and class, come back."""
    values = held(kinds.select("label", "weight", F.posexplode(F.col("expanded").cast("array<double>")).alias("at", "x")).groupBy("at", "x", "label").agg(F.sum("weight").alias("weight")))
    gap = (F.max("x") - F.min("x")) / (F.count_distinct("x") - 1)
    precision = held(values.groupBy("at").agg(F.when(F.count_distinct("x") > 1, gap).otherwise(NO_GAP).alias("p")))
    rounded = values.join(F.broadcast(precision), "at").withColumn("r", F.rint(F.col("x") / F.col("p")) * F.col("p"))  # a row a column
    total, mean = F.sum("weight"), F.sum(F.col("r") * F.col("weight")) / F.sum("weight")
    means = rounded.groupBy("at", "label").agg(mean.alias("mean"))
    spread = rounded.join(F.broadcast(means), ["at", "label"]).groupBy("at", "label").agg(
        F.first("mean").alias("mean"), F.greatest(F.sqrt(F.sum(F.pow(F.col("r") - F.col("mean"), F.lit(2)) * F.col("weight")) / total), F.first("p") / 6).alias("deviation")
    )
    shares = {r["label"]: r["n"] for r in kinds.groupBy("label").agg(total.alias("n")).collect()}
    found = sorted(spread.collect(), key=lambda r: r["at"])
    of = lambda label, c: [r[c] for r in found if r["label"] == label]
    classes = {label: (math.log((n + 1) / (sum(shares.values()) + 2)), of(label, "mean"), of(label, "deviation")) for label, n in shares.items()}
    return PreciseBayes([r["p"] for r in sorted(precision.collect(), key=lambda r: r["at"])], classes)
