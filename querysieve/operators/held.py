"""Cutting a plan: what several later steps read is computed once and kept in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_setting = Lock()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder that ``spark.checkpoint.dir`` names; a local one of our own only in a session without executors."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="querysieve-checkpoint-"))


def held(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later steps read shared files, also after an executor is lost.

    The shuffle files that it took are deleted as soon as it is written; else they stay until the driver happens to collect its
    garbage, and those of one step after another add up.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    with _setting:  # it counts when a frame is made, not when it runs
        before = spark.conf.get(CLEAN_UP, "false")
        spark.conf.set(CLEAN_UP, "true")
        try:
            own = df.select("*")
        finally:
            spark.conf.set(CLEAN_UP, before)
    return own.checkpoint(eager=True)
