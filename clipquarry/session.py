"""Session settings shared by the bench, the tests and stand-alone runs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


# Bytes in a batch between Spark and Python: a frame has 4 KB, so the usual number of rows would be 40 MB in each worker.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session with batches of bounded size. Only queries call this; operators leave the session as it is."""
    size = spark.conf.get(BATCH_SETTING, None)
    if size is None or not size.rstrip("b").isdigit() or int(size.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return spark


def build_session(
    app: str, cpus: int | str = "*", shuffle_partitions: int | None = None, checkpoint_dir: str | None = None
) -> SparkSession:
    """A local session with the settings the operators assume."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return builder.getOrCreate()
