"""Result envelopes and result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def result_envelope(ok: Column, payload: list[Column], error: Column) -> Column:
    """JSON text of a result: `success` with the payload, or with the error alone."""
    done = F.to_json(F.struct(F.lit(True).alias("success"), *payload))
    failed = F.to_json(F.struct(F.lit(False).alias("success"), error.alias("error")))
    return F.when(ok, done).otherwise(failed)


def write_results(results: DataFrame, folder: str, partition: str, file_format: str = "parquet") -> None:
    """Write results, replacing only the partitions that occur in them."""
    (
        results.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .format(file_format)
        .save(folder)
    )
