"""The query log that the registered queries run on.

The test tables hold no log of query strings, so one is derived from ``orders``: twelve kinds of strings, benign and
malicious, some of them repeated, encoded or malformed.  The same text is used in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querysieve.functions.features import SLOTS, features
from querysieve.functions.items import items, with_label_item
from querysieve.functions.sqltext import recognised
from querysieve.functions.text import normalized

# The kinds of strings by remainder of the order key.  {k} is the order key, {c} the customer key.
KINDS = [
    "'select * from orders where o_orderkey = ' || {k}",
    "'1'' or ''1''=''1'",
    "'select%20name%20from%20customer%20where%20id%3D' || {c}",
    "'select a from b union all select c from d union select e from f where x = 1 or y = 2 and z = ' || {c} || ' and long_padding_column_name_for_length = 100'",
    "o_orderpriority",
    "'admin''--' || {c}",
    "'select  *   from t where a like ''%x' || {c} || ''''",
    "'o''r''e''i' || {c}",
    "'x=1 or a=2 or b=3 or c=' || {c}",
    "'select 1 where 1=1 where 2=' || {c}",
    "'a--b' || {c} || '#c'",
    "'hello+world+' || {c}",
]
MALICIOUS_KINDS = (1, 3, 5, 8, 9, 10)


def corpus_sql(text_type: str) -> str:
    """id, raw_sql, label from ``orders``; ``text_type`` is the dialect's name for strings."""
    key, customer = f"cast(o_orderkey as {text_type})", f"cast(o_custkey as {text_type})"
    cases = "\n".join(f" WHEN {k} THEN {kind.format(k=key, c=customer)}" for k, kind in enumerate(KINDS[:-1]))
    return (
        f"SELECT o_orderkey AS id, CASE o_orderkey % 12\n{cases}\n ELSE {KINDS[-1].format(k=key, c=customer)} END AS raw_sql,\n"
        f" CASE WHEN o_orderkey % 12 IN {MALICIOUS_KINDS} THEN 1 ELSE 0 END AS label\nFROM orders"
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, raw_sql, label; only the two keys and the priority of ``orders`` are read."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority")
    return spark.sql(corpus_sql("string").replace("FROM orders", "FROM {orders}"), orders=orders)


def featured(rows: DataFrame, raw: str = "raw_sql", parsed: bool = False) -> DataFrame:
    """Adds the slots; ``parsed`` also tries to recognise each string as a statement (``accepted``)."""
    rows = rows.withColumn("p", normalized(F.col(raw)))
    if not parsed:
        return rows.withColumns(features(F.col("p")))
    rows = rows.withColumn("parsed", recognised(F.col("p")))
    return rows.withColumns(features(F.col("p"), F.col("parsed"))).withColumn("accepted", F.col("parsed").isNotNull())


def transactions(rows: DataFrame, stage: int = 4) -> DataFrame:
    """``rows`` with slots and label -> ``items`` added."""
    return rows.withColumn("items", with_label_item(items(), F.col("label"), stage))


__all__ = ["SLOTS", "corpus", "corpus_sql", "featured", "transactions"]
