"""Registry reads as a stream: each micro-batch is answered by the as-of lookups of the batch form.

Between batches a table keeps what later reads depend on: live registrations, the last sweep of each registry, and rows that the watermark has not
passed. Rows are answered in order of their moments once the watermark passes them, so the answers do not depend on how rows were cut into
batches. Rows older than the watermark go to a table of their own, unanswered.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipquarry.operators.jobs import LATENESS
from clipquarry.operators.registry import LIFETIMES, LOG, lifetime, registry_reads
from clipquarry.streaming.run import checkpoint_folder, snapshot


def live_rows(log: DataFrame, lifetimes: Mapping[str, str] = LIFETIMES) -> DataFrame:
    """Log rows that stand for all of `log` to whoever reads later: the last registration of each key that no sweep has dropped, and the last sweep
    of each registry."""
    flags = lambda sweeps: {"sweeps": F.lit(sweeps), "registers": F.lit(not sweeps), "reads": F.lit(False)}
    moment = F.struct("at", "event_id")
    sweeps = log.filter(F.col("sweeps")).groupBy("registry").agg(F.max(moment).alias("row")).select("registry", "row.*")
    entries = log.filter(F.col("registers")).groupBy("registry", "key").agg(F.max(moment).alias("row")).select("registry", "key", "row.*")
    last = sweeps.select("registry", F.col("at").alias("swept_at"))  # a row a registry
    gone = F.coalesce(F.col("at") < F.col("swept_at") - lifetime(lifetimes), F.lit(False))
    entries = entries.join(F.broadcast(last), "registry", "left").filter(~gone).drop("swept_at")
    entries, sweeps = entries.withColumns(flags(False)), sweeps.withColumn("key", F.lit(None).cast("string")).withColumns(flags(True))
    return entries.select(*LOG).unionByName(sweeps.select(*LOG))


def run_reads(
    log: DataFrame, name: str, folder: str, lifetimes: Mapping[str, str] = LIFETIMES, lateness: str = LATENESS, timeout_seconds: int = 3600
) -> None:
    """Answer what has arrived since the last run, then stop. Answers are in `folder`/reads, late rows in `folder`/late.

    Every batch overwrites its own part of both, and the state table takes turns between two places, so a batch that failed half-way is repeated
    without a trace.
    """
    marker = {"registry": None, "key": None, "event_id": None, "sweeps": False, "registers": False, "reads": False}

    def fold(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows = rows.select(*LOG).filter(F.col("at").isNotNull())
        held = snapshot(spark, f"{folder}/state", batch - 1).drop("batch") if batch else rows.limit(0)
        clock = held.filter(F.col("registry").isNull()).agg(F.max("at")).first()[0]  # a row that only carries the clock
        newest = rows.agg(F.max("at")).first()[0]
        newest = max((t for t in (clock, newest) if t is not None), default=None)
        passed = lambda t: F.date_trunc("millisecond", F.lit(t).cast("timestamp")) - F.expr(f"interval {lateness}")
        late = F.col("at") <= passed(clock) if clock is not None else F.lit(False)
        rows.filter(late).write.mode("overwrite").parquet(f"{folder}/late/batch={batch}")
        log_now = held.filter(F.col("registry").isNotNull()).unionByName(rows.filter(~late))
        ready = F.col("at") <= passed(newest)
        registry_reads(log_now.filter(ready), lifetimes).write.mode("overwrite").parquet(f"{folder}/reads/batch={batch}")
        clock_row = spark.range(1).select(*[(F.lit(newest) if c == "at" else F.lit(marker[c])).cast(dict(rows.dtypes)[c]).alias(c) for c in LOG])
        kept = reduce(DataFrame.unionByName, [live_rows(log_now.filter(ready), lifetimes), log_now.filter(~ready), clock_row])
        kept.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/state/turn={batch % 2}")

    writer = log.writeStream.trigger(availableNow=True).foreachBatch(fold)
    running = writer.option("checkpointLocation", checkpoint_folder(log.sparkSession, name)).start()
    try:
        if not running.awaitTermination(timeout_seconds):
            raise TimeoutError(f"{name} did not finish in {timeout_seconds} s")
    finally:
        running.stop()


def answers(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/reads").drop("batch")
