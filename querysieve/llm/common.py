"""Small helpers that the training-data operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querysieve.operators.held import ensure_checkpoint_dir
from querysieve.operators.held import held as cut

__all__ = ["as_bytes", "cut", "ensure_checkpoint_dir", "id_and_text", "let_go", "only_one", "remove", "shuffle_partitions", "slices", "store", "table"]

T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns the operators read; whatever else ``docs`` carries can't clash with theirs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def store(df: DataFrame, folder: str) -> DataFrame:
    """The rows written as Parquet, and read again: later steps read the columns they need, also after an executor is lost."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


_kept: dict[Hashable, object] = {}


def only_one(key: Hashable, make: Callable[[], T]) -> T:
    """A large helper that a Python worker keeps from task to task; asking for another one lets go of it.

    Workers outlive stages, so without this every operator's caches would add up in them.
    """
    if key not in _kept:
        let_go()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Frees what earlier tasks of this worker kept, and the Arrow memory that they no longer use."""
    if _kept:
        _kept.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)

