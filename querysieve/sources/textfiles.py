"""Transactions, itemsets and rules as text, one per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _joined(items: Column) -> Column:
    return F.array_join(items.cast("array<string>"), " ")


def transaction_line(items: Column) -> Column:
    """Items with a space after each; a transaction without items is an empty line."""
    return F.when(F.size(items) > 0, F.concat(_joined(items), F.lit(" "))).otherwise("")


def write_transactions(rows: DataFrame, path: str) -> None:
    rows.select(transaction_line(F.col("items")).alias("value")).write.text(path)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """``items``; empty lines and lines that start with #, % or @ hold none."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where((F.col("value") != "") & ~F.col("value").rlike("^[#%@]"))
    return lines.select(F.transform(F.split("value", " +"), lambda x: x.cast("int")).alias("items"))


def itemset_line() -> Column:
    return F.format_string("%s #SUP: %d", _joined(F.col("items")), F.col("freq"))


def write_itemsets(found: DataFrame, path: str) -> None:
    """In order of size and items; a few hundred lines at most, so one file."""
    found.orderBy(F.size("items"), "items").select(itemset_line().alias("value")).coalesce(1).write.text(path)


def rule_line() -> Column:
    return F.concat(_joined(F.col("antecedent")), F.lit(" ==> "), _joined(F.col("consequent")), F.lit(" #SUP: "), F.col("support").cast("string"), F.lit(" #CONF: "), F.col("confidence").cast("string"))


def write_rules(rules: DataFrame, path: str) -> None:
    rules.orderBy(F.size("antecedent"), "antecedent", "consequent").select(rule_line().alias("value")).coalesce(1).write.text(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """antecedent, consequent (its first item), confidence; lines without an arrow are skipped."""
    return parse_rules(spark.read.text(path))


def parse_rules(lines: DataFrame) -> DataFrame:
    lines = lines.where(F.contains("value", F.lit("==>")))
    sides = F.split("value", "==>")
    return lines.select(
        F.transform(F.split(F.trim(sides[0]), " +"), lambda x: x.cast("int")).alias("antecedent"),
        F.regexp_extract(sides[1], r"^\s*(\d+)", 1).cast("int").alias("consequent"),
        F.regexp_extract("value", r"#CONF:\s*([0-9.Ee+-]+)", 1).cast("double").alias("confidence"),
    )
