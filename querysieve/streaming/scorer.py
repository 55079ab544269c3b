"""Query strings as a stream: features and items per row, repeats dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from querysieve.functions.features import SLOTS, with_features
from querysieve.functions.items import items


def score_stream(queries: DataFrame, boundary: str = "compat") -> DataFrame:
    """A streaming (or plain) frame with ``raw_sql`` -> the slots and items added; stateless."""
    return with_features(queries, boundary=boundary).withColumn("items", items()).drop("p")


def first_seen(queries: DataFrame, time_column: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """Drops strings that were seen within the watermark; the state holds no older ones."""
    return queries.withWatermark(time_column, watermark).dropDuplicatesWithinWatermark(["raw_sql"])


def to_table(queries: DataFrame, path: str, checkpoint: str):
    """Appends scored rows to Parquet as they come; each batch once."""
    scored = score_stream(queries).select("raw_sql", *SLOTS, "items")
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
