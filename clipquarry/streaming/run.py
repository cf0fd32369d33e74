"""Running a registry stream into files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession, name: str) -> str:
    """Folder of a stream's progress and state under the shared folder the cluster names."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{root.rstrip('/')}/{name}"


def run_available(
    stream: DataFrame,
    name: str,
    folder: str,
    mode: str = "append",
    timeout_seconds: int = 3600,
    key: str | None = None,
    newest_by: str | None = None,
) -> None:
    """Process what has arrived since the last run, then stop.

    Appended rows go to a parquet folder, whose log makes them exactly-once. Updated rows are folded into a snapshot
    with the newest row of each `key` by `newest_by`. Two snapshots take turns: a batch reads the one before and
    overwrites the older one, so a batch that failed half-way is simply repeated, and nothing piles up.
    """
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True)
    writer = writer.option("checkpointLocation", checkpoint_folder(stream.sparkSession, name))
    if mode == "append":
        running = writer.format("parquet").option("path", folder).start()
    else:

        def fold(rows: DataFrame, batch: int) -> None:
            earlier = snapshot(rows.sparkSession, folder, batch - 1) if batch else None
            if earlier is not None:
                rows = rows.unionByName(earlier.drop("batch"))
            values = [c for c in rows.columns if c != key]
            newest = rows.groupBy(key).agg(F.max_by(F.struct(*values), newest_by).alias("row")).select(key, "row.*")
            newest.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/turn={batch % 2}")

        running = writer.foreachBatch(fold).start()
    try:
        if not running.awaitTermination(timeout_seconds):
            raise TimeoutError(f"{name} did not finish in {timeout_seconds} s")
    finally:
        running.stop()


def snapshot(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """The snapshot that a batch left."""
    return spark.read.parquet(f"{folder}/turn={batch % 2}").filter(F.col("batch") == batch)


def latest_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Newest row of each key that an updating stream has written so far."""
    turns = spark.read.parquet(folder).drop("turn")
    return turns.filter(F.col("batch") == turns.agg(F.max("batch")).scalar()).drop("batch")
