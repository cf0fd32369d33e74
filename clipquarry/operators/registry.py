"""What a registry answers at a time: entries live until a sweep finds them too old, and sweeps come only with some requests.

A log row does up to three things at its moment, in this order: it sweeps its registry (drops every entry registered more than a lifetime ago,
strictly), it registers its key (again: the moment is renewed), it reads its key. Rows of one moment go by their event. A key
that nothing has swept is served however old it is. Registries do not see each other.

Columns of a log: registry, key, event_id, at TIMESTAMP, sweeps, registers, reads BOOLEAN. Null flags are false; rows without
a moment happen never. A registry whose lifetime is not given keeps its entries.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipquarry.operators.jobs import ARTIFACT_TTL, JOB_TTL
from clipquarry.skew import HEAVY_ROWS, with_last

# Registries and the lifetimes of their entries.
LIFETIMES = {"artifacts": ARTIFACT_TTL, "jobs": JOB_TTL}

LOG = ["registry", "key", "event_id", "at", "sweeps", "registers", "reads"]
ORDER = ["at", "event_id"]

# Hot registries and keys are cut into stretches of so many seconds.
STRETCH_SECONDS = 60


def lifetime(lifetimes: Mapping[str, str]) -> Column:
    """The lifetime of an entry of the row's registry, null if it has none."""
    out = F.lit(None).cast("interval day to second")
    for name, text in lifetimes.items():
        out = F.when(F.col("registry") == name, F.expr(f"interval {text}")).otherwise(out)
    return out


def _stretch(at: Column) -> list[Column]:
    return [F.floor(F.unix_micros(at) / F.lit(STRETCH_SECONDS * 1_000_000)).cast("bigint")]


def _as_of(log: DataFrame, min_rows: int) -> DataFrame:
    """The log with the last registration of each row's key and the last sweep of its registry, as of the row.

    A registry is swept by all of its keys, so its rows are one hot key: lookups run inside short stretches of time, and only the last sweep of each
    stretch is carried on.
    """
    log = log.select(*LOG).filter(F.col("at").isNotNull())
    bucket = _stretch(F.col("at"))
    registered = F.when(F.col("registers"), F.col("at"))
    log = with_last(log, ["registry", "key"], ORDER, bucket, registered, "registered_at", min_rows)
    return with_last(log, ["registry"], ORDER, bucket, F.when(F.col("sweeps"), F.col("at")), "swept_at", min_rows)


def _alive(lifetimes: Mapping[str, str]) -> Column:
    gone = F.coalesce(F.col("registered_at") < F.col("swept_at") - lifetime(lifetimes), F.lit(False))
    return F.col("registered_at").isNotNull() & ~gone


def registry_reads(log: DataFrame, lifetimes: Mapping[str, str] = LIFETIMES, min_rows: int = HEAVY_ROWS) -> DataFrame:
    """One row per read: whether its key is served then (200) or unknown (404), when what is served was registered, and the last sweep."""
    served = _alive(lifetimes)
    return (
        _as_of(log, min_rows)
        .filter(F.col("reads"))
        .select(
            "registry",
            "key",
            "event_id",
            F.col("at").alias("read_at"),
            F.when(served, F.col("registered_at")).alias("registered_at"),
            "swept_at",
            served.alias("served"),
            F.when(served, 200).otherwise(404).alias("status"),
        )
    )


def _first_after(probes: DataFrame, marks: DataFrame, keys: list[str], order: list[str], name: str, min_rows: int) -> DataFrame:
    """probes with the `at` of the first of `marks` that comes after them in `order`: an as-of lookup with time running backwards.

    Both have the key columns and the numbers in `order`, which fall as time goes on; the first one is in microseconds.
    """
    side = lambda df, mark: df.withColumns({"_mark": F.lit(mark), "_at": F.col("at") if mark else F.lit(None).cast("timestamp")})
    both = side(probes, 0).unionByName(side(marks.select(*keys, *order, "at"), 1), allowMissingColumns=True)
    stretch = F.floor(F.col(order[0]) / F.lit(STRETCH_SECONDS * 1_000_000)).cast("bigint")
    found = with_last(both, keys, [*order, "_mark"], [stretch], F.col("_at"), name, min_rows)
    return found.filter(F.col("_mark") == 0).drop("_mark", "_at", *order)


def registry_lifetimes(log: DataFrame, lifetimes: Mapping[str, str] = LIFETIMES, min_rows: int = HEAVY_ROWS) -> DataFrame:
    """One row per registration: until when it is served, and why no longer: `swept`, or `replaced` by a newer one of its key; `alive` if neither."""
    log = log.select(*LOG).filter(F.col("at").isNotNull())
    moment = {"back": -F.unix_micros("at"), "event_back": -F.coalesce("event_id", F.lit(-1))}
    entries = log.filter(F.col("registers")).select("registry", "key", "event_id", "at")
    entries = _first_after(entries.withColumns(moment), entries.withColumns(moment), ["registry", "key"], list(moment), "replaced_at", min_rows)
    # What sweeps at the very end of a lifetime does not drop the entry.
    due = entries.withColumn("back", -F.unix_micros(F.col("at") + lifetime(lifetimes)))
    sweeps = log.filter(F.col("sweeps")).select("registry", "at").withColumn("back", moment["back"])
    lasting, limited = due.filter(F.col("back").isNull()).drop("back"), due.filter(F.col("back").isNotNull())
    found = _first_after(limited, sweeps, ["registry"], ["back"], "swept_at", min_rows).unionByName(lasting, allowMissingColumns=True)
    swept = F.coalesce(F.col("swept_at") <= F.coalesce("replaced_at", "swept_at"), F.lit(False))
    return found.select(
        "registry",
        "key",
        "event_id",
        F.col("at").alias("registered_at"),
        F.least("swept_at", "replaced_at").alias("served_until"),
        F.when(swept, "swept").when(F.col("replaced_at").isNotNull(), "replaced").otherwise("alive").alias("fate"),
    )
