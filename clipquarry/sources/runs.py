"""Results that come in whole runs: a reader sees a run with all its rows or not at all, and repeating a run changes nothing.

A run writes its rows into a folder of its own. What makes it visible is a manifest, one small file written after all of them:
a row for each value of the partition column that occurs in the run. For each value readers take the newest run that has it, so
a run replaces the partitions that occur in it and no other. A writer that stops before its manifest leaves
files that nobody reads. Runs are numbered by the caller; a number that has a manifest is not written again. If two writers
commit one number at the same time, readers settle on the same one of them.

Manifests hold a row per run and partition, are read as a table, and never come to the driver. Null is a partition as any other.
Nothing is deleted, so a reader that has begun is not disturbed.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "number bigint, level int, run string, part string"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share. A local session that names none gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="results-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """All committed runs and their partitions."""
    try:
        return spark.read.schema(MANIFEST).json(f"{folder}/manifests/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def stage_run(results: DataFrame, folder: str, partition: str) -> str:
    """Write the rows of a run, which nobody sees yet, and return the run's name. Folders are named v and the value, or n for null, as
    a folder's name can't be empty."""
    run = uuid.uuid4().hex
    part = F.coalesce(F.concat(F.lit("v"), F.col(partition).cast("string")), F.lit("n"))
    results.withColumn("_part", part).write.partitionBy("_part").parquet(f"{folder}/rows/_run={run}")
    return run


def _stored(spark: SparkSession, folder: str, schema: StructType, glob: str = "*") -> DataFrame:
    kept = StructType(schema.fields).add("_run", "string").add("_part", "string")
    return spark.read.schema(kept).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/_run={glob}")


def publish_run(spark: SparkSession, run: str, number: int, folder: str, schema: StructType) -> None:
    """Make a staged run visible: its manifest is one file, which appears when it is complete."""
    found = _stored(spark, folder, schema, run).select(F.col("_part").alias("part")).distinct()
    rows = found.select(F.lit(number).cast("bigint").alias("number"), F.lit(0).alias("level"), F.lit(run).alias("run"), "part")
    rows.coalesce(1).write.json(f"{folder}/manifests/{run}")


def commit_run(results: DataFrame, number: int, folder: str, partition: str) -> bool:
    """Write and publish a run; False, and nothing written, if this number has been published before."""
    spark = results.sparkSession
    if not manifests(spark, folder).filter(F.col("number") == number).isEmpty():
        return False
    publish_run(spark, stage_run(results, folder, partition), number, folder, results.schema)
    return True


def newest_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(part, number, level, run): the run that each partition is read from."""
    newest = F.max(F.struct("number", "level", "run")).alias("newest")
    # All levels are 0 or more; the planner prunes folders by a joined table only if that has a condition.
    return manifests(spark, folder).groupBy("part").agg(newest).select("part", "newest.*").filter("level >= 0")


def read_runs(spark: SparkSession, folder: str, schema: StructType, number: str | None = None) -> DataFrame:
    """The rows of each partition's newest run; `number` names a column for the run's number. Only files of these are read, as
    run and partition are folders."""
    newest = newest_runs(spark, folder)
    if newest.isEmpty():
        empty = spark.createDataFrame([], schema)
        return empty.withColumn(number, F.lit(None).cast("bigint")) if number else empty
    stored = _stored(spark, folder, schema)
    named = newest.select(F.col("run").alias("_run"), F.col("part").alias("_part"), F.col("number").alias("_number"))
    live = stored.join(named, ["_run", "_part"])
    columns = [F.col(f"`{c}`") for c in schema.names]
    return live.select(*columns, *[F.col("_number").alias(n) for n in [number] if n])


def compact(spark: SparkSession, folder: str, schema: StructType, partition: str, files: int = 1) -> None:
    """Write each partition's newest rows again, in about `files` files each. The copy takes the number of the run it stands
    for, one level higher, so a newer run that is published meanwhile stays the newest."""
    of = newest_runs(spark, folder)
    before = f"{folder}/compacted/{uuid.uuid4().hex}"
    of.write.parquet(before)  # the runs that are copied, whatever is published from here on
    of = spark.read.schema(of.schema).parquet(before)
    named = of.select(F.col("run").alias("_run"), F.col("part").alias("_part"))
    rows = _stored(spark, folder, schema).join(named, ["_run", "_part"]).select(*[F.col(f"`{c}`") for c in schema.names])
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in schema.names]), F.lit(files))
    run = stage_run(rows.repartition(F.col(partition), spread), folder, partition)
    copied = of.select("number", (F.col("level") + 1).alias("level"), F.lit(run).alias("run"), "part")
    copied.coalesce(1).write.json(f"{folder}/manifests/{run}")
