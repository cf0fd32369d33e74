"""Access to the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipquarry.functions.semantics import instant_of


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, root: str) -> DataFrame:
    """The event log with `ts` as an instant; it is stored as UTC wall time without a zone."""
    return table(spark, root, "events").withColumn("ts", instant_of(F.col("ts")))
