"""Labelled query logs as CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querysieve.operators.importing import first_of_each, new_only, skip_bad_rows
from querysieve.sources.csvblocks import read_records


def read_log(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """``Query`` and ``Label`` of RFC 4180 files with a header -> raw_sql, label (text) and ``ord`` (file order).

    Columns are found by name; quoted fields may hold line breaks and doubled quotes; blank lines are skipped.  ``ord``
    rises within a file in its order, and between files in order of their names.

    Files are split whatever their fields hold (``csvblocks``); for a log without line breaks in fields,
    ``line_breaks=False`` saves the pass that tells how blocks begin.
    """
    if line_breaks:
        names, records = read_records(spark, path)
        if names and not {"Query", "Label"} <= set(names):
            raise ValueError(f"no Query and Label among the columns {names}")
        at = lambda name: F.get("fields", F.lit(names.index(name) if names else 0))
        return records.select(F.coalesce(at("Query"), F.lit("")).alias("raw_sql"), at("Label").alias("label"), F.struct("file", "block", "row").alias("ord"))
    rows = spark.read.options(header=True, quote='"', escape='"', encoding="UTF-8", enforceSchema=False, inferSchema=False).csv(path)
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    return rows.select(F.coalesce("Query", F.lit("")).alias("raw_sql"), F.col("Label").alias("label"), order.alias("ord"))


def import_log(log: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """raw_sql, label, n_dups of the rows to add: bad labels skipped, the first of equal strings, none the table has."""
    rows = first_of_each(skip_bad_rows(log), "raw_sql", ["ord"]).select("raw_sql", "label", "n_dups")
    return rows if table is None else new_only(rows, table)
