"""Writing features of pending rows, batch by batch.

The feature table is partitioned by ``batch``, a range of ids.  A run finds the batches that miss rows, computes them from
the log and overwrites just these partitions, some at a time.  Every such write is whole or not there, so a run that stops
half-way leaves finished batches, and the next one goes on with the others; run again, it writes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querysieve.functions.features import SLOTS, with_features

BATCH_ROWS, AT_ONCE = 1_000_000, 64


def create(spark: SparkSession, name: str = "features") -> None:
    """The feature table, unless it is there."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (id BIGINT, {', '.join(f'{s} DOUBLE' for s in SLOTS)}, batch BIGINT) USING parquet PARTITIONED BY (batch)")


def pending_batches(log: DataFrame, name: str = "features", batch_rows: int = BATCH_ROWS) -> list[int]:
    """The batches of ``log`` (id, raw_sql) that have a row without features; one number per batch."""
    done = log.sparkSession.table(name).select("id", "batch")
    return sorted(r["batch"] for r in _batched(log, batch_rows).select("id", "batch").join(done, ["id", "batch"], "left_anti").select("batch").distinct().collect())


def _batched(log: DataFrame, batch_rows: int) -> DataFrame:
    return log.withColumn("batch", F.floor(F.col("id") / batch_rows).cast("long"))


def fill(log: DataFrame, name: str = "features", boundary: str = "compat", batch_rows: int = BATCH_ROWS, at_once: int = AT_ONCE) -> int:
    """Fills what is pending; returns how many batches were written."""
    pending = pending_batches(log, name, batch_rows)
    for at in range(0, len(pending), at_once):
        write_batches(_batched(log, batch_rows).where(F.col("batch").isin(pending[at : at + at_once])), name, boundary)
    return len(pending)


def write_batches(rows: DataFrame, name: str, boundary: str = "compat") -> None:
    """Overwrites the partitions that ``rows`` (id, raw_sql, batch) lie in with the features of these rows."""
    found = with_features(rows.select("id", "raw_sql", "batch"), boundary=boundary).select("id", *SLOTS, "batch")
    conf, key = rows.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
    before = conf.get(key)
    conf.set(key, "dynamic")  # an option of the writer isn't heeded where rows go into a table
    try:
        found.write.insertInto(name, overwrite=True)
    finally:
        conf.set(key, before)
