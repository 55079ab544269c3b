"""Feature vectors extended by mined patterns and rules, in seven scenarios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querysieve.functions.features import SLOTS
from querysieve.operators.held import held
from querysieve.operators.mining import itemsets
from querysieve.operators.rules import association_rules, first_consequent


BROADCAST = 10_000  # kinds of item sets


@dataclass(frozen=True)
class Scenario:
    """What is mined from the training part and what becomes of it: "patterns", "rules" or nothing."""

    number: int
    name: str
    uses: str | None = None
    min_support: float | None = None
    min_confidence: float | None = None


# The experiment's scenarios.  6 and 7 mine rules too strict to add columns; nothing is mined for them.
SCENARIOS = {
    s.number: s
    for s in (
        Scenario(1, "base features"),
        Scenario(2, "patterns at 0.05", "patterns", 0.05),
        Scenario(3, "patterns at 0.1", "patterns", 0.1),
        Scenario(4, "rules at 0.1 / 0.6", "rules", 0.1, 0.6),
        Scenario(5, "rules at 0.05 / 0.6", "rules", 0.05, 0.6),
        Scenario(6, "rules at 0.05 / 0.8, unused", None, 0.05, 0.8),
        Scenario(7, "rules at 0.1 / 0.8, unused", None, 0.1, 0.8),
    )
}


def holds(pattern: Column, own: Column) -> Column:
    """Whether all items of the pattern are among a row's own."""
    return F.size(F.array_except(pattern, own)) == 0


def holds_rule(rule: Column, own: Column) -> Column:
    return holds(rule["antecedent"], own) & F.array_contains(own, rule["consequent"])


def mined_columns(train: DataFrame, scenario: Scenario) -> DataFrame | None:
    """One row with an array ``mined`` of what the scenario adds, in a fixed order; None if it adds nothing."""
    if scenario.uses is None:
        return None
    found = itemsets(train, scenario.min_support)
    if scenario.uses == "patterns":
        ordered = F.array_sort(F.collect_list(F.struct(F.size("items").alias("size"), "items")))
        return found.agg(F.transform(ordered, lambda x: x["items"]).alias("mined"))
    rules = association_rules(found, scenario.min_confidence)
    columns = F.struct(F.size("antecedent").alias("size"), "antecedent", F.col("consequent").alias("whole"), F.element_at("consequent", 1).alias("consequent"), "confidence")
    return rules.agg(F.array_sort(F.collect_list(columns)).alias("mined"))


def kinds_expanded(rows: DataFrame, mined: DataFrame, uses: str, per_kind: dict[str, Column] | None = None) -> DataFrame:
    """Distinct ``items`` -> ``extra``: 1 or 0 per pattern, or the confidence or 0 per rule, and ``per_kind``; each kind is looked at once."""
    if uses == "patterns":
        extra = F.transform("mined", lambda p: holds(p, F.col("items")).cast("float"))
    else:
        extra = F.transform("mined", lambda r: F.when(holds_rule(r, F.col("items")), r["confidence"]).otherwise(0.0).cast("float"))
    # ``mined`` is one row by construction.
    return held(rows.select("items").distinct().join(F.broadcast(mined)).select("items", extra.alias("extra")).withColumns(per_kind or {}))


def expand(rows: DataFrame, train: DataFrame, scenario: int, per_kind: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``expanded array<float>``: the eight slots, then 1 or 0 per pattern or the confidence or 0 per rule.

    ``rows`` and ``train`` have the slots and ``items``.  Patterns and rules are tested on kinds of item sets, of which
    the item dictionary allows a few hundred, and joined back; the kinds are broadcast up to ``BROADCAST`` of them.
    ``per_kind`` are further columns to add, over ``extra`` (what follows the slots): they are worked out once a kind.
    """
    chosen, per_kind = SCENARIOS[scenario], per_kind or {}
    base = F.array(*[F.col(s).cast("float") for s in SLOTS])
    mined = mined_columns(train, chosen)
    if mined is None:
        return rows.withColumn("extra", F.array().cast("array<float>")).withColumns({"expanded": base, **per_kind}).drop("extra")
    kinds = kinds_expanded(rows, mined, chosen.uses, per_kind)
    kinds = F.broadcast(kinds) if kinds.count() <= BROADCAST else kinds
    columns = [c for c in rows.columns if c != "expanded"]
    return rows.join(kinds, "items").withColumn("expanded", F.concat(base, "extra")).select(*columns, "expanded", *per_kind)


__all__ = ["SCENARIOS", "Scenario", "expand", "first_consequent", "holds", "holds_rule", "mined_columns"]
