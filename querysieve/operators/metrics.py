"""Confusion metrics of a prediction table, in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ["tp", "fp", "fn", "tn", "accuracy", "p1", "r1", "f1", "p0", "r0", "f0", "macro_f1"]


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def confusion_metrics(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``predictions`` (label, prediction; 1 is positive, everything else isn't) -> counts and metrics, per ``by``.

    Rows with a ``weight`` (a whole number) stand for as many.

    Accuracy is in percent; a metric without anything to count is 0.
    """
    yes, said = F.col("label") == 1, F.col("prediction") == 1
    one = F.col("weight") if "weight" in predictions.columns else F.lit(1)
    count = lambda which: F.coalesce(F.sum(F.when(which, one).otherwise(0)), F.lit(0)).cast("long")
    found = predictions.groupBy(*(by or [])).agg(count(yes & said).alias("tp"), count(~yes & said).alias("fp"), count(yes & ~said).alias("fn"), count(~yes & ~said).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    found = found.withColumns({"accuracy": _ratio(tp + tn, tp + fp + fn + tn) * 100, "p1": _ratio(tp, tp + fp), "r1": _ratio(tp, tp + fn), "p0": _ratio(tn, tn + fn), "r0": _ratio(tn, tn + fp)})
    f = lambda k: _ratio(2 * F.col(f"p{k}") * F.col(f"r{k}"), F.col(f"p{k}") + F.col(f"r{k}"))
    found = found.withColumns({"f1": f(1), "f0": f(0)}).withColumn("macro_f1", (F.col("f1") + F.col("f0")) / 2)
    return found.select(*(by or []), *METRICS)


def report(metrics: dict[str, float], name: str) -> str:
    """The metrics of one model as text."""
    return (
        f"{name}\n  Accuracy: {metrics['accuracy']:.2f}%\n"
        f"  Class 1: precision {metrics['p1']:.4f}, recall {metrics['r1']:.4f}, F1 {metrics['f1']:.4f}\n"
        f"  Class 0: precision {metrics['p0']:.4f}, recall {metrics['r0']:.4f}, F1 {metrics['f0']:.4f}\n"
        f"  Macro F1: {metrics['macro_f1']:.4f}"
    )
