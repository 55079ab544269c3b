"""The training table: schema, creation, reading and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querysieve.operators.held import held
from querysieve.operators.importing import first_of_each, new_only

TRAINING_DATA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("raw_sql", T.StringType(), False),
        T.StructField("feature_vector", T.ArrayType(T.DoubleType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("is_trained", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)


DEFAULTS = {"is_trained": "0", "created_at": "current_timestamp()"}


def create(spark: SparkSession, name: str = "training_data", buckets: int | None = None) -> None:
    """Creates the table unless it is there; running it again changes nothing.

    ``raw_sql`` is unique because ``append`` is the way in; Spark itself keeps no unique columns.  With ``buckets`` rows lie
    in so many files by the hash of ``raw_sql``: an import then reads the table where it is and shuffles only what comes in.
    """
    column = lambda f: f"{f.name} {f.dataType.simpleString()}" + (" NOT NULL" if not f.nullable else "") + (f" DEFAULT {DEFAULTS[f.name]}" if f.name in DEFAULTS else "")
    clustered = f" CLUSTERED BY (raw_sql) INTO {buckets} BUCKETS" if buckets else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(map(column, TRAINING_DATA))}) USING parquet{clustered}")


def buckets_of(spark: SparkSession, name: str) -> int | None:
    """How many buckets the table has."""
    said = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    return int(said["Num Buckets"]) if "Num Buckets" in said else None


def read(spark: SparkSession, name: str = "training_data") -> DataFrame:
    return spark.table(name)


def names(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def append(rows: DataFrame, name: str = "training_data") -> dict[str, int]:
    """Adds the rows whose ``raw_sql`` the table doesn't have, the first (by id) of equal ones, in one atomic write.

    Missing columns get their defaults.  Returns how many rows were ``attempted`` and how many ``inserted``, both counted
    by the write itself.
    """
    spark, attempted, inserted = rows.sparkSession, Observation(), Observation()
    absent = {f.name: F.expr(DEFAULTS.get(f.name, "null")) for f in TRAINING_DATA if f.name not in rows.columns}
    ordered = rows.withColumns(absent).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TRAINING_DATA])
    ordered = ordered.observe(attempted, F.count("*").alias("n"))
    held(fresh_rows(ordered, name).observe(inserted, F.count("*").alias("n"))).write.insertInto(name)
    return {"attempted": attempted.get["n"], "inserted": inserted.get["n"]}


def fresh_rows(rows: DataFrame, name: str = "training_data") -> DataFrame:
    """Of equal ``raw_sql`` the first row by id, if the table has none.

    Dealt as the table's buckets are, if it has any, so that one shuffle of what comes in serves both steps.
    """
    spark = rows.sparkSession
    buckets = buckets_of(spark, name)
    dealt = rows.repartition(buckets, "raw_sql") if buckets else rows
    return new_only(first_of_each(dealt, "raw_sql", ["id"]).drop("n_dups"), spark.table(name)).select(*TRAINING_DATA.names)
