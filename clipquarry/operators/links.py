"""Groups of what is linked, directly or through others.

Two kinds of rounds take turns until nothing changes. In a large star every node ties its larger neighbours to the smallest
of itself and its neighbours, in a small star its smaller ones. What is left is one star per group, around its smallest node.
Minima are combined before the shuffle, a node of very many links is salted, and each round is written to a shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipquarry.skew import HEAVY_ROWS, salted_join
from clipquarry.sources.runs import scratch_folder


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write `df` into the shared folder and read it back, which cuts its lineage."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _star(links: DataFrame, heavy_rows: int) -> DataFrame:
    """Links (u, v) as (v, smallest of u and all its neighbours), and u itself tied to that."""
    least = links.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    far = salted_join(links, least, ["u"], ["v"], min_rows=heavy_rows).select(F.col("v").alias("u"), F.col("least").alias("v"))
    near = least.select("u", F.col("least").alias("v"))
    return far.unionByName(near).filter("u <> v").distinct()


def _mark(links: DataFrame) -> tuple:
    """What tells one set of links from another: their number and two checksums of 64 bits."""
    parts = [F.bit_xor(F.xxhash64(F.lit(k), "u", "v")) for k in range(2)]
    return tuple(links.agg(F.count("*"), *parts).first())


def connected(links: DataFrame, a: str, b: str, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(node, group) of each node that `links` ties to another one; `group` is the smallest node of its group.

    Null ends, loops and repeated links are ignored; no links give no rows.
    """
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNull().alias("x"), F.col(b).isNull().alias("y"))
    stars = landed(ends.filter("not x and not y and u <> v").select("u", "v").distinct(), "links")
    mark = _mark(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
        upward = salted_join(stars.select(F.col("v").alias("u"), F.col("u").alias("v")), least, ["u"], ["v"], min_rows=heavy_rows)
        large = landed(upward.select(F.col("v").alias("u"), F.col("least").alias("v")).distinct(), "links")
        small = landed(_star(large, heavy_rows), "links")
        # Each step keeps the groups, so links that come back unchanged are stars.
        mark, before = _mark(small), mark
        if mark == before:
            return small.select(F.col("u").alias("node"), F.col("v").alias("group")).unionByName(
                small.select(F.col("v").alias("node"), F.col("v").alias("group")).distinct()
            )
        stars = small
