"""Train and test parts of exact sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRAIN_SHARE = 0.8
DIGITS = 4  # of the hash, counted at once


def with_place(rows: DataFrame, text: str = "raw_sql", key: str = "id") -> DataFrame:
    """Adds ``place``, where a row stands in a fixed shuffle that any engine can repeat: the md5 of its text and key."""
    return rows.withColumn("place", F.md5(F.concat_ws("|", F.coalesce(F.col(text), F.lit("")), F.col(key).cast("string")).cast("binary")))


def split_by_place(rows: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    """``place`` -> ``is_train``: the ``floor(share x n)`` rows of the smallest places.

    Where the order is cut is found by counting rows by the next ``DIGITS`` hex digits, only within the group in which the
    border falls; nothing is sorted or ranked, and rows of one text lie all over the order.  Rows that repeat text and key
    can't be told apart and stay on one side.
    """
    wanted, border = None, ""
    while len(border) < 32:
        group = F.substring("place", 1, len(border) + DIGITS)
        counts = sorted(map(tuple, rows.where(F.col("place").startswith(border)).groupBy(group.alias("g")).agg(F.count("*").alias("n")).collect()))  # 65,536 at most
        wanted = int(share * sum(n for _, n in counts)) if wanted is None else wanted
        for g, n in counts:
            if n > wanted:
                border = g
                break
            wanted -= n
        else:
            border = "g"  # beyond every digit: all rows are wanted
            break
        if not wanted:
            break
    return rows.withColumn("is_train", F.col("place") < border).drop("place")


def split(rows: DataFrame, text: str = "raw_sql", key: str = "id", share: float = TRAIN_SHARE) -> DataFrame:
    """Adds ``is_train``, in exact sizes."""
    return split_by_place(with_place(rows, text, key), share)


def java_shuffled(n: int, seed: int) -> list[int]:
    """The order that a shuffle by the 48-bit linear congruential generator of the JVM gives 0..n-1.

    For comparing with runs made elsewhere on small inputs: it is one long chain of draws, so it can't be distributed.
    A help for tests, which no query uses.
    """
    # Multiplier, increment and mask of that generator.
    multiplier, increment, mask = 0x5DEECE66D, 0xB, (1 << 48) - 1
    state = (seed ^ multiplier) & mask
    order = list(range(n))

    def draw() -> int:
        nonlocal state
        state = (state * multiplier + increment) & mask
        return state >> 17

    for size in range(n, 1, -1):
        bits = draw()
        if size & (size - 1) == 0:
            pick = size * bits >> 31
        else:
            pick = bits % size
            while bits - pick + size - 1 >= 1 << 31:
                bits = draw()
                pick = bits % size
        order[size - 1], order[pick] = order[pick], order[size - 1]
    return order


def java_split(rows: DataFrame, position: str, seed: int = 42, share: float = TRAIN_SHARE, most: int = 1_000_000) -> DataFrame:
    """Adds ``is_train`` as that shuffle decides; ``position`` counts rows from 0 without gaps.  At most ``most`` rows."""
    n = rows.count()
    if n > most:
        raise ValueError(f"{n} rows; use split() for more than {most}")
    spark, order = rows.sparkSession, java_shuffled(n, seed)
    schema = T.StructType([T.StructField(position, T.LongType()), T.StructField("is_train", T.BooleanType())])
    return rows.join(spark.createDataFrame([(k, at < int(share * n)) for at, k in enumerate(order)], schema), position)
