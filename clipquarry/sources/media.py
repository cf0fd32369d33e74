"""Landed media files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipquarry.functions.routing import ANALYSIS_MAX, MEDIA_MIN


def scan_media_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Name and size of the files in a folder, and why a file is refused. The content column is not
    selected, so no file is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        "length",
        F.when(F.col("length") < MEDIA_MIN, "too_small").when(F.col("length") > ANALYSIS_MAX["direct"], "too_large").alias("reject_reason"),
    )


def image_files(names: DataFrame) -> DataFrame:
    """Rows whose `name` is that of a frame image."""
    return names.filter(F.lower("name").rlike(r"\.(jpg|jpeg|png)$"))
