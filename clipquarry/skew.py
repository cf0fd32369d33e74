"""Helpers that keep one hot key from landing in one task.

All of them are exact: rows are spread differently, never dropped or capped. How many keys are hot is counted
before the plan is made, from the key columns alone. Mostly none are, and the plan stays a plain window or join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key with fewer rows than this fits one task with ease and is not worth spreading.
HEAVY_ROWS = 100_000

# Hot keys that are broadcast at most; a longer list is joined by shuffle.
BROADCAST_KEYS = 10_000


def heavy_keys(df: DataFrame, keys: Sequence[str], min_rows: int = HEAVY_ROWS) -> DataFrame:
    """All keys with `min_rows` rows or more and their `count`, which combines before the shuffle."""
    counts = df.select(*keys).dropna().groupBy(*keys).count()
    return counts.filter(F.col("count") >= min_rows)


def _null_in(keys: Sequence[str]) -> Column:
    """Whether a key is missing."""
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def _listed(df: DataFrame, keys: Sequence[str], min_rows: int) -> tuple[DataFrame | None, bool]:
    """The hot keys, marked for broadcast while they are few, or nothing; and whether missing keys are hot."""
    counts = df.select(*keys).groupBy(*keys).count().filter(F.col("count") >= min_rows)
    seen = counts.select(_null_in(keys).cast("int").alias("missing")).limit(BROADCAST_KEYS + 2)
    size, missing = seen.agg(F.count("*"), F.coalesce(F.max("missing"), F.lit(0))).first()
    if size == missing:
        return None, bool(missing)
    heavy = counts.dropna()
    return (F.broadcast(heavy) if size <= BROADCAST_KEYS else heavy), bool(missing)


def with_running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Sequence[Column], value: Column, name: str, min_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Add the sum of `value` over the rows of a key up to and with this one, in `order`, which tells them apart.

    A hot key is cut into buckets: totals run inside (key, bucket), and the totals of its earlier buckets, which are
    made with a map-side combine, are added. `bucket` must not decrease along `order` within a key. Window and join
    share their partitioning, so the rows are shuffled once.
    """
    run = lambda by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    heavy, _ = _listed(df, keys, min_rows)
    if heavy is None:
        return df.withColumn(name, F.sum(value).over(run(keys)))
    names = [f"_bucket{i}" for i in range(len(bucket))]
    marked = df.join(heavy, list(keys), "left").withColumns({n: F.when(F.col("count").isNotNull(), b) for n, b in zip(names, bucket)})
    group = [*keys, *names]

    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.filter(F.col("count").isNotNull())
        .groupBy(*group)
        .agg(F.sum(value).alias("_size"))
        .withColumn("_offset", F.sum("_size").over(before))
        .drop("_size")
    )
    return (
        marked.withColumn("_inside", F.sum(value).over(run(group)))
        .join(offsets, group, "left")
        .withColumn(name, F.col("_inside") + F.coalesce("_offset", F.lit(0)))
        .drop("count", "_inside", "_offset", *names)
    )


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Sequence[Column], name: str, min_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Add the 0-based position of a row inside its key, in `order`; see `with_running_total`."""
    counted = with_running_total(df, keys, order, bucket, F.lit(1).cast("bigint"), name, min_rows)
    return counted.withColumn(name, F.col(name) - 1)


def with_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Sequence[Column], value: Column, name: str, min_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Add the newest `value` that is not null among the rows of a key up to and with this one, in `order`: an as-of lookup.

    A hot key is cut into buckets like in `with_running_total`: the lookup runs inside (key, bucket), and where a bucket has no value yet
    the last one of the earlier buckets is taken, of which each bucket has one row.
    """
    run = lambda by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    heavy, _ = _listed(df, keys, min_rows)
    if heavy is None:
        return df.withColumn(name, F.last(value, ignorenulls=True).over(run(keys)))
    names = [f"_bucket{i}" for i in range(len(bucket))]
    marked = df.join(heavy, list(keys), "left").withColumns({n: F.when(F.col("count").isNotNull(), b) for n, b in zip(names, bucket)})
    group = [*keys, *names]

    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    # Max of (order, value) is the newest value; null orders come first, as they do in a window.
    newest = F.max(F.when(value.isNotNull(), F.struct(*order, value.alias("_value"))))
    carried = (
        marked.filter(F.col("count").isNotNull())
        .groupBy(*group)
        .agg(newest.alias("_newest"))
        .withColumn("_carried", F.last("_newest._value", ignorenulls=True).over(before))
        .drop("_newest")
    )
    return (
        marked.withColumn("_inside", F.last(value, ignorenulls=True).over(run(group)))
        .join(carried, group, "left")
        .withColumn(name, F.coalesce("_inside", "_carried"))
        .drop("count", "_inside", "_carried", *names)
    )


def salted_join(
    many: DataFrame,
    side: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    min_rows: int = HEAVY_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join `many` (inner or left) with `side`, spreading the hot keys of `many` over tasks.

    A key gets a salt for every `min_rows` rows it has, and the rows of `side` under it are repeated that often. Rows of
    `many` without a key are spread too, where there are as many.
    `spread_by` names columns of `many` that tell the rows of one key apart; the salt is a hash of them, so a lost
    task recomputes the same rows. `counted` may name a cheaper table that has the keys of `many` equally often.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join keeps all rows of `many` or only the matching ones")
    heavy, missing = _listed(many if counted is None else counted, keys, min_rows)
    if heavy is None and not missing:
        return many.join(side, list(keys), how)
    # A missing key meets nothing, so its rows may go anywhere.
    hashed = F.xxhash64(*spread_by)
    if heavy is None:
        salted = many.withColumn("_salt", F.when(_null_in(keys), hashed).otherwise(F.lit(0).cast("bigint")))
        # A plain 0 would be folded into the condition, and the salt would no longer be a key.
        zero = F.explode(F.array(F.lit(0).cast("bigint")))
        return salted.join(side.withColumn("_salt", zero), [*keys, "_salt"], how).drop("_salt")
    salts = F.ceil(F.col("count") / min_rows)
    salt = F.when(_null_in(keys), hashed).when(F.col("count").isNull(), F.lit(0)).otherwise(F.pmod(hashed, salts))
    salted = many.join(heavy, list(keys), "left").withColumn("_salt", salt.cast("bigint")).drop("count")
    every = F.sequence(F.lit(0).cast("bigint"), F.coalesce(salts, F.lit(1)).cast("bigint") - 1)
    repeated = side.join(heavy, list(keys), "left").withColumn("_salt", F.explode(every)).drop("count")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
