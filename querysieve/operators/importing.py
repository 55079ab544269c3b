"""Getting labelled query logs into the training table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querysieve.functions.features import SLOTS, with_features


def skip_bad_rows(log: DataFrame) -> DataFrame:
    """Rows whose label is an integer as text, with ``label`` as int; others are left out.

    Blanks around the digits make a label bad, as does a number beyond 32 bits.
    """
    return log.where(F.col("label").rlike(r"^[+-]?[0-9]+$")).withColumn("label", F.col("label").try_cast("int")).where("label is not null")


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of every key in the given order, and how many rows it stands for (``n_dups``).

    The exact first row wins, with its label.  An aggregate, not a window: rows of one key combine before the shuffle,
    so a string that fills a third of the log is no more work than any other.
    """
    others = [c for c in rows.columns if c != key]
    packed = rows.select(key, F.struct(*order, *[c for c in others if c not in order]).alias("row"))
    kept = packed.groupBy(key).agg(F.min("row").alias("row"), F.count("*").alias("n_dups"))
    return kept.select(*[F.col(f"row.{c}").alias(c) if c != key else F.col(key) for c in rows.columns], "n_dups")


def new_only(incoming: DataFrame, table: DataFrame, key: str = "raw_sql") -> DataFrame:
    """Incoming rows whose key the table doesn't have yet."""
    return incoming.join(table.select(key), key, "left_anti")


def pending(table: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows that have no features yet."""
    return table.join(done.select(key), key, "left_anti")


def fill_features(table: DataFrame, done: DataFrame, boundary: str = "compat") -> DataFrame:
    """Features of all rows: those done before as they are, the others computed now; a second run changes nothing."""
    fresh = with_features(pending(table, done), boundary=boundary).select("id", *SLOTS)
    return done.select("id", *SLOTS).unionByName(fresh)
